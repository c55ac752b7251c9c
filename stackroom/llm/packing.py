"""Best-fit packing of tokenised documents into sequences of a fixed length, by the sum of squares.

A document's tokens, with an end token behind them, are one piece, or pieces of a whole sequence each if they are more; only
the first of these may be shorter. Pieces are dealt at random to groups of about GROUP_PIECES, each packed in one task. A
group's pieces, longest first, go where the squared counts of open sequences per residual gap become smallest; on a tie,
where the least is left over. That rule keeps sequences open for pieces to come; at the end of a group none come, so the
sequences that are still open are emptied, and their pieces go, longest first, where they fit best.

Tokens are those of the library `tokenizers` with the vocabulary byte_bpe_50k.json. The same vocabulary is also given as
ranks, which tiktoken reads several times as fast; the ids are equal around every Unicode character, as a test asserts. Its
regular expressions fail on white space of some 10^6 characters, so that texts with more than LONG_SPACE of it in a run go
to `tokenizers`. Strings of special tokens in a text are ordinary text.

Defined cases: a null text counts as empty, and an empty one is one piece of the end token; repeated rows are packed each;
null ids are ids; a very long text is tokenised whole; an empty table gives an empty result; further columns are not read,
but for those named in `keys`.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.llm.common import python_path, table, written

LENGTH, END_TOKEN = 1024, 2
#: Pieces that one task packs: a bound of its memory, and so many that the sequences it leaves open don't count.
GROUP_PIECES = 20_000
#: White space from which on a text is left to the slower library.
LONG_SPACE = 10_000

Encoder = Callable[[str], np.ndarray]


@cache
def byte_bpe() -> Encoder:
    """text -> ids, made once a worker."""
    slow = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    spaces = re.compile(rf"\s{{{LONG_SPACE}}}")

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_SPACE and spaces.search(text):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def _cut(batches, keys: list[str], length: int, end: int, encoder: Callable[[], Encoder], keep_ids: bool):
    encode = encoder()
    names = [*keys, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    for batch in batches:
        row, piece, start, size, crc, ids = [], [], [], [], [], []
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            tokens = np.append(encode((text.as_py() or b"").decode("utf-8", "replace")), end).astype("<u4")
            first = (len(tokens) - 1) % length + 1
            for n, at in enumerate([0, *range(first, len(tokens), length)]):
                part = tokens[at : at + length if n else first]
                row.append(i), piece.append(n), start.append(at), size.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                if keep_ids:
                    ids.append(part.astype(np.int32))
        columns = [pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, size, crc)), *([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else [])]
        yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row, pa.int64())) for k in keys), *columns], names)


def pieces_of(docs: DataFrame, keys: list[str], length: int = LENGTH, end: int = END_TOKEN, encoder: Callable[[], Encoder] = byte_bpe, keep_ids: bool = True) -> DataFrame:
    """docs (keys, text) -> keys, piece (from 0), start, length, ids_crc32, and ids if they are kept."""
    python_path(docs.sparkSession)
    made = T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""))
    schema = T.StructType([*(docs.schema[k] for k in keys), *made.fields])
    return docs.select(*keys, "text").mapInArrow(lambda batches: _cut(batches, keys, length, end, encoder, keep_ids), schema)


def _place(sizes: np.ndarray, length: int, squares: bool = True) -> tuple[np.ndarray, int]:
    """(bin of each size, number of bins); sizes are placed in the order given, by the sum of squares or by best fit."""
    open_bins = np.zeros(length + 1, np.int64)  # by gap
    of_gap: dict[int, list[int]] = {}
    bins, n = np.zeros(len(sizes), np.int64), 0
    for i, size in enumerate(sizes.tolist()):
        fits = open_bins[size:length]
        if squares:
            # Squares change by 1 - 2 n where a bin leaves its gap, and by 2 n + 1 where it takes another one that isn't 0.
            change = 1 - 2 * fits
            change[1:] += 2 * open_bins[1 : length - size] + 1
            change[fits == 0] = np.iinfo(np.int64).max
            fresh = 2 * open_bins[length - size] + 1 if size < length else 0
            best = int(change.argmin()) if len(change) else -1
            best = best if best >= 0 and change[best] <= fresh else -1
        else:
            best = int((fits > 0).argmax()) if len(fits) else -1
            best = best if best >= 0 and fits[best] else -1
        if best >= 0:
            open_bins[size + best] -= 1
            at, gap = of_gap[size + best].pop(), best
        else:
            at, gap, n = n, length - size, n + 1
        bins[i] = at
        if gap:
            open_bins[gap] += 1
            of_gap.setdefault(gap, []).append(at)
    return bins, n


def pack_sizes(sizes: np.ndarray, length: int) -> np.ndarray:
    """The sequence (from 0) of each size, none over `length`."""
    order = np.argsort(-sizes, kind="stable")
    bins, n = _place(sizes[order], length)
    filled = np.bincount(bins, sizes[order], n)
    full = filled == length
    # The rule leaves sequences open for pieces to come. At the end none come: what is open is closed by best fit.
    again = np.flatnonzero(~full[bins])
    placed, fewer = _place(sizes[order][again], length, squares=False)
    if fewer < np.count_nonzero(~full):
        bins = np.cumsum(full)[bins] - 1
        bins[again] = placed + np.count_nonzero(full)
    out = np.empty(len(sizes), np.int64)
    out[order] = bins
    return out


def _packed(group: pa.Table, length: int) -> pa.Table:
    sizes = group["length"].to_numpy()
    bins = pack_sizes(sizes, length)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    offset = np.empty(len(sizes), np.int64)
    offset[order] = before - before[np.searchsorted(bins[order], bins[order])]
    number = (group["_group"].to_numpy().astype(np.int64) << 32) + bins
    return group.drop_columns(["_group"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))


def pack(pieces: DataFrame, length: int = LENGTH, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (length, ...) with sequence_id and offset, the piece's place in the sequence."""
    # Every row has its number, so that many rows of one key, or equal ones, are dealt to all groups alike.
    numbered = written(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-numbered.count() // group_pieces))
    dealt = numbered.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups))).drop("_row")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.groupBy("_group").applyInArrow(lambda group: _packed(group, length), schema)


def sequences(packed: DataFrame, keys: list[str]) -> DataFrame:
    """packed pieces with their ids -> sequence_id, ids, spans (keys, piece, offset, length), in the order of the places."""
    span = F.struct("offset", *keys, "piece", "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(span)).alias("_spans"))
    spans = F.transform("_spans", lambda s: s.dropFields("ids"))
    return rows.select("sequence_id", F.flatten(F.transform("_spans", lambda s: s["ids"])).alias("ids"), spans.alias("spans"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(pieces_of(docs, ["doc_id"], keep_ids=False)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
