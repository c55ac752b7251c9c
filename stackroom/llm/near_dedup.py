"""MinHash near-deduplication of documents: improved consistent weighted sampling over TF-IDF shingles, banded, with
every link verified by weighted Jaccard similarity.

A shingle is five words; its weight is its count in the document times ln(1 + N / df), where df is the number of documents
that hold it, counted exactly over all of them. Consecutive documents form chunks of about CHUNK bytes. A chunk asks for the
frequencies of its shingles, each once, in arrays cut by ranges of the hash; one task counts a range over all chunks and
answers each chunk with those of more than one document; all others are its own. So a row of the shuffle is an array, a
shingle of every document is one entry a chunk, and a range's entries and a chunk's texts are all that a task holds.

Identical texts form one node. In each bucket of each band, nodes are first paired with the one of most copies. Where
nodes of more than one class are left, GROWTH times as many leaders are drawn among them in each further round, and paired
with all nodes of other classes, until what is left of every bucket is of one class. So any two nodes that share a bucket
are compared or linked by others, in rounds that grow with the logarithm of a bucket; only nodes that stay in different
classes are all compared, block by block, and only links leave a block. Of the first round's pairs, those whose sketches
agree in fewer than LEAST_AGREEING samples are left out, which links pass with a probability above 0.99999; the others are
verified. Classes are the components of verified links.

Defined cases: a null text counts as empty; texts under five words are one shingle; texts without words match only
identical texts; very long texts are sketched whole, in blocks; ids are of any type that can be ordered, and a null id
never names a class unless all its ids are null; repeated rows are in one class, and one row of it is kept; an empty table
gives an empty result; further columns pass through the pipeline stage.
"""

from __future__ import annotations

from collections import OrderedDict
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.llm.common import BROADCAST_ROWS, discard, python_tasks, table, text_of, written
from stackroom.llm.components import components
from stackroom.llm.shingles import shingle_hashes

SIMILARITY = 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: 0.9999 at 0.8.
BANDS, ROWS = 14, 3
#: Shingles of a lesser share of the documents have the weight of this share; 0: each has that of its own frequency.
DF_FLOOR = 0.0
#: The share of the documents that idf_table supposes for a shingle that none of them holds.
UNSEEN = 0.1
#: Bytes of text of a chunk, and of the texts whose shingles fall into one range, on average.
CHUNK, RANGE = 3 << 19, 16 << 20
#: Bytes that a text counts more than its own, so that empty ones fill a chunk, too.
ROW_BYTES = 64
SEED = 7
#: Leaders of a bucket in a round, as a multiple of those in the round before.
GROWTH = 32
#: Nodes of a bucket, and leaders, that meet in one block.
DEALT = 256
#: Two sketches are compared by three bits of each sample; this many samples agree, by chance or not.
LEAST_AGREEING = 22
#: Shingles that one numpy step works on.
BLOCK = 8192

#: Values that r and beta, and c, take: quantiles of their distributions, so that draws by a hash's bits follow them.
_R_BITS, _C_BITS = 12, 16


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles (i + 1/2) / n of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x), by bisection."""
    share, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 64.0)
    for _ in range(60):
        middle = (low + high) / 2
        under = 1 - (1 + middle) * np.exp(-middle) < share
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


class Sampler:
    """Draws of the sampling: r and c are Gamma(2, 1), beta is uniform, each looked up by bits of a shingle's hash."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(1 << 62, size=samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        r = _gamma_quantiles(1 << _R_BITS)
        self.r, self.inverse_r = r.astype(np.float32), (1 / r).astype(np.float32)
        self.log_c = np.log(_gamma_quantiles(1 << _C_BITS)).astype(np.float32)
        self.beta = ((np.arange(1 << _R_BITS) + 0.5) / (1 << _R_BITS)).astype(np.float32)

    def least(self, shingles: np.ndarray, log_weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Least log a of each sample (rows) over each document (columns). Documents that draw the same shingle at the
        same level get the same number, and practically only those, so that the number stands for the draw."""
        out = np.empty((len(self.odd), len(starts)), np.float32)
        r_mask, c_mask, s1, s2, s3 = np.uint64((1 << _R_BITS) - 1), np.uint64((1 << _C_BITS) - 1), np.uint64(52), np.uint64(40), np.uint64(24)
        for k, odd in enumerate(self.odd):
            mixed = shingles * odd
            i, j, m = (mixed >> s1).astype(np.intp), ((mixed >> s2) & r_mask).astype(np.intp), ((mixed >> s3) & c_mask).astype(np.intp)
            r, beta = self.r[i], self.beta[j]
            level = np.floor(log_weights * self.inverse_r[i] + beta)
            out[k] = np.minimum.reduceat(self.log_c[m] - r * (level - beta + np.float32(1)), starts)
        return out


def _bands(least: np.ndarray) -> np.ndarray:
    """Documents by bands: a hash of the band's samples."""
    bits = least.view(np.uint32).astype(np.uint64).reshape(BANDS, ROWS, -1)
    out = np.zeros((BANDS, bits.shape[2]), np.uint64)
    for row in range(ROWS):
        out = (out ^ bits[:, row]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.T.view(np.int64)


def _agreement_bits(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three bits of each sample, in two longs a document."""
    bits = least.view(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(61)
    half = BANDS * ROWS // 2
    packed = [np.zeros(least.shape[1], np.uint64) for _ in range(2)]
    for k, three in enumerate(bits):
        packed[k // half] |= three << np.uint64(3 * (k % half))
    return packed[0].view(np.int64), packed[1].view(np.int64)


def _agreeing(x: str, y: str) -> Column:
    """Samples whose three bits are the same."""
    ones = F.lit(sum(1 << 3 * k for k in range(BANDS * ROWS // 2)))
    out = F.lit(BANDS * ROWS)
    for side in ("low", "high"):
        differ = F.col(f"{x}.{side}").bitwiseXOR(F.col(f"{y}.{side}"))
        out = out - F.bit_count(differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseOR(F.shiftrightunsigned(differ, 2)).bitwiseAND(ones))
    return out


def _chunked(batches, limit: int):
    """Rows with the number of their chunk: about `limit` bytes of consecutive texts of a task."""
    held, start = 0, int(np.random.default_rng().integers(1 << 61))
    for batch in batches:
        ends = held + np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES)
        held = int(ends[-1]) if len(ends) else held
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start + ends // limit)], [*batch.schema.names, "chunk"])


def _asked(batches, ranges: int):
    """chunk, range, shingles (sorted, as bytes), n (documents of these rows that hold each, as bytes)."""
    chunk, held = None, []

    def asked():
        shingles, n = np.unique(np.concatenate(held), return_counts=True)
        place = ((shingles >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(place)) + 1
        first = np.append(0, cuts) if len(place) else cuts
        arrays = [[x.tobytes() for x in np.split(whole, cuts)[: len(first)]] for whole in (shingles, n.astype(np.uint32))]
        return pa.RecordBatch.from_arrays([pa.array([chunk] * len(first), pa.int64()), pa.array(place[first]), *(pa.array(x, pa.binary()) for x in arrays)], ["chunk", "range", "shingles", "n"])

    for batch in batches:
        for number, text in zip(batch.column("chunk").to_pylist(), batch.column("text"), strict=True):
            if held and number != chunk:
                yield asked()
                held = []
            chunk = number
            held.append(np.unique(shingle_hashes(text.as_py())))
    if held:
        yield asked()


def _counted(asked: pa.Table, least: int) -> pa.Table:
    """What all chunks asked of one range -> chunk, shingles, dfs of those that `least` documents hold."""
    each = [np.frombuffer(x, np.uint64) for x in asked.column("shingles").to_pylist()]
    whole, n = np.concatenate(each), np.concatenate([np.frombuffer(x, np.uint32) for x in asked.column("n").to_pylist()])
    if least > 1:
        ordered = np.sort(whole)
        often = np.unique(np.concatenate([ordered[1:][ordered[1:] == ordered[:-1]], whole[n > 1]]))
    else:
        often = np.unique(whole)
    at = np.minimum(np.searchsorted(often, whole), max(len(often) - 1, 0))
    known = often[at] == whole if len(often) else np.zeros(len(whole), bool)
    dfs = np.bincount(at[known], weights=n[known], minlength=len(often)).astype(np.uint32)
    chunks, shingles, counts, start = [], [], [], 0
    for chunk, own in zip(asked.column("chunk").to_pylist(), each, strict=True):
        here = slice(start, start + len(own))
        start += len(own)
        if known[here].any():
            chunks.append(chunk), shingles.append(own[known[here]].tobytes()), counts.append(dfs[at[here][known[here]]].tobytes())
    return pa.table([pa.array(chunks, pa.int64()), pa.array(shingles, pa.binary()), pa.array(counts, pa.binary())], ["chunk", "shingles", "dfs"])


def in_chunks(rows: DataFrame) -> DataFrame:
    """rows (with text), written, with chunk."""
    schema = T.StructType([*rows.schema.fields, T.StructField("chunk", T.LongType())])
    return written(rows.mapInArrow(partial(_chunked, limit=CHUNK), schema), "chunks")


def frequencies(chunked: DataFrame, least: int = 2) -> DataFrame:
    """chunk, shingles, dfs: of a chunk's shingles those that at least so many of all documents hold, in some rows of arrays."""
    ranges = 1 + (chunked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE
    asked = chunked.select("chunk", "text").mapInArrow(partial(_asked, ranges=ranges), "chunk long, range int, shingles binary, n binary")

    def counted(group: pa.Table) -> pa.Table:
        return _counted(group, least)

    return written(asked.groupBy("range").applyInArrow(counted, "chunk long, shingles binary, dfs binary"), "frequencies")


def _weights_of(answers: pa.Table, all_docs: int, floor: float, others: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(shingles, sorted; their idf; the idf of all others, which so many documents hold) of rows of frequencies."""
    shingles, dfs = (np.frombuffer(b"".join(answers.column(c).to_pylist()), kind) for c, kind in (("shingles", np.uint64), ("dfs", np.uint32)))
    shingles, place = np.unique(shingles, return_index=True)
    idf = lambda df: np.log1p(all_docs / np.maximum(df, max(floor * all_docs, 1)))
    return shingles, idf(dfs[place].astype(np.float64)).astype(np.float32), float(idf(others))


def idf_table(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(shingles, sorted; their idf; the idf of a shingle that no document holds): of a collection that fits the driver, all
    the weights that the operator uses, for tests and a look at them. The operator itself never gathers them."""
    chunked = in_chunks(docs.select(text_of().alias("text")))
    all_docs = max(1, chunked.count())
    answers = frequencies(chunked, 1)
    found = answers.select("shingles", "dfs").toArrow()
    discard(chunked, answers)
    return _weights_of(found, all_docs, DF_FLOOR, UNSEEN * all_docs)


def weighted_shingles(text: str | None, idf: tuple[np.ndarray, np.ndarray, float]) -> tuple[np.ndarray, np.ndarray]:
    shingles, counts = np.unique(shingle_hashes(text), return_counts=True)
    often, weights, other = idf
    idfs = np.full(len(shingles), other, np.float32)
    if len(often) and len(shingles):
        at = np.minimum(np.searchsorted(often, shingles), len(often) - 1)
        known = often[at] == shingles
        idfs[known] = weights[at[known]]
    return shingles, counts.astype(np.float32) * idfs


def _sketch(batches, idf):
    sampler = Sampler()

    def drawn(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        sizes = np.array([len(s) for s, _ in parts])
        whole, weights = np.concatenate([s for s, _ in parts]), np.log(np.concatenate([w for _, w in parts]))
        return sampler.least(whole, weights, np.append(0, sizes.cumsum()[:-1]))

    def drawn_in_blocks(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A text longer than a block: the least of its blocks' least."""
        logs = np.log(weights)
        each = [sampler.least(shingles[i : i + BLOCK], logs[i : i + BLOCK], np.zeros(1, np.intp)) for i in range(0, len(shingles), BLOCK)]
        return np.minimum.reduce(each)

    for batch in batches:
        bands: list = [None] * batch.num_rows
        weighted: list = [b""] * batch.num_rows
        low, high = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        parts, at, held = [], [], 0

        def put(places: list[int], least: np.ndarray) -> None:
            low[places], high[places] = _agreement_bits(least)
            for i, row in zip(places, _bands(least), strict=True):
                bands[i] = row

        def flush() -> None:
            if parts:
                put(at, drawn(parts))
            parts.clear(), at.clear()

        for i, text in enumerate(batch.column("text")):
            shingles, weights = weighted_shingles(text.as_py(), idf)
            weighted[i] = weights.tobytes()
            if len(shingles) > BLOCK:
                put([i], drawn_in_blocks(shingles, weights))
            elif len(shingles):
                if held + len(shingles) > BLOCK:
                    flush()
                    held = 0
                parts.append((shingles, weights)), at.append(i)
                held += len(shingles)
        flush()
        lists = pa.array([[] if b is None else b for b in bands], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("did"), batch.column("row"), lists, pa.array(low), pa.array(high), pa.array(weighted, pa.binary())], ["node", "did", "row", "bands", "low", "high", "weights"])


def _sketches(chunked: DataFrame, all_docs: int) -> DataFrame:
    """node, did, row, bands, low, high, and weights: those of the text's shingles in the order of their hashes, as bytes."""
    kind, floor, answers = chunked.schema["did"].dataType.simpleString(), DF_FLOOR, frequencies(chunked)
    schema = f"node binary, did {kind}, row long, bands array<long>, low long, high long, weights binary"

    def sketched(texts: pa.Table, answered: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_sketch(texts.to_batches(), _weights_of(answered, all_docs, floor, 1)))

    made = written(chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(sketched, schema), "sketches")
    discard(answers)
    return made


def _weighted(text: str | None, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingles and the weights that its sketch was made with."""
    return np.unique(shingle_hashes(text)), np.frombuffer(weights, np.float32)


def _similarities(batches):
    """Weighted Jaccard similarity of each pair's texts."""
    cache: OrderedDict = OrderedDict()

    def weighted(node: bytes, text, weights) -> tuple[np.ndarray, np.ndarray]:
        if node not in cache:
            cache[node] = _weighted(text.as_py(), weights.as_py())
            if len(cache) > 32:
                cache.popitem(last=False)
        return cache[node]

    for batch in batches:
        out = np.zeros(batch.num_rows)
        columns = [batch.column(c) for c in ("a", "b", "a_text", "b_text", "a_weights", "b_weights")]
        for i, (a, b, a_text, b_text, a_weights, b_weights) in enumerate(zip(*columns, strict=True)):
            (sa, wa), (sb, wb) = weighted(a.as_py(), a_text, a_weights), weighted(b.as_py(), b_text, b_weights)
            _, ia, ib = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
            shared = float(np.minimum(wa[ia], wb[ib]).sum(dtype=np.float64))
            whole = float(wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64)) - shared
            out[i] = shared / whole if whole else 0.0
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], ["a", "b", "similarity"])


def node_of() -> Column:
    return F.unhex(F.md5(F.encode(text_of(), "UTF-8")))


def _same_row(x: str, y: str) -> list[Column]:
    return [F.col(f"{x}.node") == F.col(f"{y}.node"), F.col(f"{x}.did").eqNullSafe(F.col(f"{y}.did"))]


def _texts(wanted: DataFrame, nodes: DataFrame, rows: DataFrame, sketched: DataFrame) -> DataFrame:
    """node, text, weights of the wanted nodes, from one row of each."""
    named = written(wanted.join(nodes.select("node", "did"), "node"), "wanted")
    few = named.count() <= BROADCAST_ROWS

    def of_wanted(df: DataFrame, column: str) -> DataFrame:
        found = df.alias("r").join((F.broadcast(named) if few else named).alias("w"), _same_row("r", "w"), "left_semi")
        return found.select("node", column).dropDuplicates(["node"])

    return of_wanted(rows, "text").join(of_wanted(sketched, "weights"), "node")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, sketched: DataFrame) -> DataFrame:
    """(a, b) -> a, b, similarity."""
    pairs = written(pairs, "pairs")
    # Written as it is joined: an aggregate between scan and join would keep Spark from splitting a hot node's rows.
    texts = written(_texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, rows, sketched), "texts")
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"{x}_text"), F.col("weights").alias(f"{x}_weights"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_text", "b_text", "a_weights", "b_weights")
    checked = written(both.mapInArrow(_similarities, "a binary, b binary, similarity double"), "similarities")
    discard(pairs, texts)
    return checked


def _open_members(rest: DataFrame, roots: DataFrame) -> DataFrame:
    """rest with root and members (their number), of the buckets in which nodes of more than one class are left."""
    classed = rest.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classed = written(classed, "classed")
    several = classed.groupBy("band", "value").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("members")).where("lo != hi")
    out = written(classed.join(several.drop("lo", "hi"), ["band", "value"]), "open")
    discard(classed)
    return out


def _as_sets(batches):
    """node, shingles (sorted hashes) and weights of each text, as bytes."""
    for batch in batches:
        shingles = [np.unique(shingle_hashes(text.as_py())).tobytes() for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(shingles, pa.binary()), batch.column("weights")], ["node", "shingles", "weights"])


def _links_of_block(block: pa.Table, similarity: float) -> pa.Table:
    """Links between the leaders and the members of a block: each leader's weights are laid over those of all members."""
    node, root = block.column("node").to_pylist(), block.column("root").to_pylist()
    shingles = [np.frombuffer(x, np.uint64) for x in block.column("shingles").to_pylist()]
    weights = [np.frombuffer(x, np.float32) for x in block.column("weights").to_pylist()]
    leads = block.column("leads").to_numpy()
    leaders, members = np.flatnonzero(leads), np.flatnonzero(~leads)
    found = []
    if len(leaders) and len(members):
        known, place = np.unique(np.concatenate([shingles[i] for i in members]), return_inverse=True)
        weight = np.concatenate([weights[i] for i in members])
        starts = np.append(0, np.cumsum([len(shingles[i]) for i in members])[:-1])
        sums = np.add.reduceat(weight, starts, dtype=np.float64)
        for x in leaders:
            at = np.minimum(np.searchsorted(known, shingles[x]), len(known) - 1)
            own, same = np.zeros(len(known), np.float32), known[at] == shingles[x]
            own[at[same]] = weights[x][same]
            shared = np.add.reduceat(np.minimum(own[place], weight), starts, dtype=np.float64)
            alike = shared / (sums + weights[x].sum(dtype=np.float64) - shared)
            for k in np.flatnonzero(alike >= similarity):
                y = members[k]
                if root[x] != root[y]:
                    found.append((min(node[x], node[y]), max(node[x], node[y]), float(alike[k])))
    a, b, s = zip(*found, strict=True) if found else ((), (), ())
    return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s, pa.float64())], ["a", "b", "similarity"])


def _met(rest: DataFrame, sets: DataFrame, drawn: int, similarity: float) -> DataFrame:
    """a, b, similarity: links of leaders with nodes of other classes of their bucket. A bucket's members are dealt to
    parts and its leaders to blocks, of about DEALT nodes each; every part meets every block in a task of its own, which
    has each node's shingles once and gives out links only."""
    dealt = lambda number, seed: F.pmod(F.xxhash64("node", F.lit(seed)), number).cast("int")
    parts = F.ceil(F.col("members") / DEALT).cast("int")
    blocks = F.ceil(F.least(F.col("members"), F.lit(drawn)) / DEALT).cast("int")
    held = rest.select("band", "value", "node", "root", "leads", "members")
    members = held.select("*", dealt(parts, -1).alias("part"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")).withColumn("leads", F.lit(False))
    leaders = held.where("leads").select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), dealt(blocks, -2).alias("block"))
    meeting = members.union(leaders.select(*members.columns)).join(sets, "node").select("band", "value", "part", "block", "node", "root", "leads", "shingles", "weights")

    def links_of_block(block: pa.Table) -> pa.Table:
        return _links_of_block(block, similarity)

    links = meeting.groupBy("band", "value", "part", "block").applyInArrow(links_of_block, "a binary, b binary, similarity double")
    return written(links.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "met")


def near_duplicates(docs: DataFrame, key: str = "doc_id", similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows, links). rows: node, did, class_id, class_did, class_node, class_size and kept (one row of each class) for
    every row of docs; links: the verified links a, b, similarity between nodes, whose texts differ."""
    python_tasks(docs.sparkSession)
    # Rows are numbered as they are written, so that one of several equal rows can be told from the others.
    rows = in_chunks(docs.select(node_of().alias("node"), F.col(key).alias("did"), F.monotonically_increasing_id().alias("row"), text_of().alias("text")))
    sketched = _sketches(rows, max(1, rows.count()))
    rank = F.struct(F.col("did").isNull().alias("unnamed"), "did", "row")
    firsts = [F.first(c).alias(c) for c in ("bands", "low", "high")]
    nodes = written(sketched.groupBy("node").agg(F.min(rank).alias("first"), F.min("did").alias("lowest"), F.count("*").alias("copies"), *firsts).withColumn("did", F.col("first.did")), "nodes")

    held = nodes.select("node", "copies", "low", "high", F.posexplode("bands").alias("band", "value"))
    lead = F.max(F.struct("copies", "node", "low", "high"))
    # Written, so that Spark can split the rows of a hot bucket as it joins them.
    leaders = written(held.groupBy("band", "value").agg(lead.alias("x"), F.count("*").alias("n")).where("n > 1").drop("n"), "leaders")
    member = written(held.join(leaders, ["band", "value"]).select("band", "value", "x", "node", "low", "high"), "buckets")
    first = member.select("x", F.struct("node", "low", "high").alias("y")).where((F.col("x.node") != F.col("y.node")) & (_agreeing("x", "y") >= LEAST_AGREEING))
    checked = _verified(first.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), nodes, rows, sketched)
    roots = components(checked.where(F.col("similarity") >= similarity))

    # The others are compared with further leaders until all that is left of a bucket is of one class.
    links = checked.where(F.col("similarity") >= similarity)
    rest, drawn, sets = member.where("node != x.node").drop("x"), 1, None
    while True:
        rest = _open_members(rest, roots)
        if rest.isEmpty():
            break
        sets = sets or written(_texts(rest.select("node").distinct(), nodes, rows, sketched).mapInArrow(_as_sets, "node binary, shingles binary, weights binary"), "sets")
        drawn *= GROWTH
        leads = F.pmod(F.xxhash64("node", F.lit(drawn)), F.lit(1 << 30)) < F.lit(float(drawn << 30)) / F.col("members")
        rest = written(rest.withColumn("leads", (F.col("members") <= drawn) | leads), "rest")
        more = _met(rest, sets, drawn, similarity)
        rest = rest.where("NOT leads").select("band", "value", "node", "low", "high")
        if not more.isEmpty():
            links = links.union(more)
            roots = components(links)
    discard(rows)

    rooted = written(nodes.join(roots, "node", "left").select("node", "first", "lowest", "copies", F.coalesce("root", "node").alias("root")), "rooted")
    best = F.min(F.struct("first.unnamed", "first.did", "node", "first.row"))
    classes = rooted.groupBy("root").agg(F.min("lowest").alias("class_id"), best.alias("best"), F.sum("copies").alias("class_size"))
    named = rooted.join(classes, "root").select("node", "class_id", F.col("best.did").alias("class_did"), F.col("best.node").alias("class_node"), F.col("best.row").alias("class_row"), "class_size")
    placed = sketched.select("node", "did", "row").join(named, "node")
    return placed.withColumn("kept", (F.col("node") == F.col("class_node")) & (F.col("row") == F.col("class_row"))), links


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(F.col("did").alias("doc_id"), "class_id", "class_size", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class of near copies, that with the least id. Only what goes is looked up, so
    that texts don't move as long as it can be broadcast. Of rows of one id and text, that of the least hash stays."""
    rows, _ = near_duplicates(docs)
    places = written(rows.groupBy("node", "did").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1"), "going")
    looked_up = lambda df: F.broadcast(df) if places.count() <= BROADCAST_ROWS else df
    keyed = docs.select(node_of().alias("node"), F.col("doc_id").alias("did"), F.struct(*docs.columns).alias("row"))
    single = keyed.alias("k").join(looked_up(places).alias("p"), _same_row("k", "p"), "left_anti")
    several = keyed.alias("k").join(looked_up(places.where("kept")).alias("p"), _same_row("k", "p"), "left_semi")
    one = several.groupBy("node", "did").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return single.select("row.*").union(one.select("row.*"))
