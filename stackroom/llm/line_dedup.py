"""Near-duplicate lines across all documents: an exact set-similarity join, by DataFrame functions only.

A line's tokens are its five-word shingles (a shorter line is one token), hashed to 64 bits. Lines are told apart by the
MD5 of their words; equal lines are one line with copies. Two lines of the required similarity share a token among the
first ones of each, the prefixes, in whatever order all lines' tokens are sorted. This is used twice:

1. In the order of their hashes, which needs no counts. Prefixes longer by t - 1 tokens share t of them, so that a line
   stays in the search only if that many tokens of its prefix are in other lines' prefixes; t grows with the line. A
   passage that many lines share is a small part of a prefix and keeps few of them. Of the lines that stay all tokens are
   counted, and a line stays only if enough of its tokens are in another.
2. In the order of rarity, by the number of searched lines that hold a token. Tokens of a single line come first and make
   no pair. The shorter line of a pair is found by a shorter prefix, as in PPJoin; the length and positional filters
   follow, then a bound on the tokens that differ, from the tokens of a single line and from 128 bits of the others. What
   is left is verified by Jaccard similarity. Postings of a frequent token are dealt to several tasks.

All links between different lines are found. Of two matching lines, equal or similar, the later one is removed; first is
the least (key, line number). Classes are the components of links. Lines of few tokens can be different and yet have
equal token sets; each of these is linked with the first of them, and counts them all.

Defined cases: a null text has no lines; lines without words are kept and belong to no class; an empty table gives an
empty result; of repeated rows and ids all but one count as later; very long lines are lines like others; further columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.llm.common import BROADCAST_KEYS, BROADCAST_ROWS, discard, possible, table, written
from stackroom.llm.components import components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Postings of a token that one task pairs with its others.
DEALT = 1024
#: Postings carry the earlier tokens of prefixes up to this length, so that a pair is found at one token only; pairs of
#: longer prefixes may be found several times and are made distinct.
CARRIED = 24
#: A line of n tokens is to share 1 + n / TOKENS_A_SHARE tokens of its prefix in the order of hashes.
TOKENS_A_SHARE = 16


def raw_lines(docs: DataFrame) -> DataFrame:
    """doc, row, line_no (from 0), raw (a hash of the line as it stands), said (the line); docs has doc, row and text."""
    lines = docs.where(F.col("text").isNotNull()).select("doc", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "said"))
    return lines.select("doc", "row", "line_no", F.xxhash64("said").alias("raw"), "said")


def with_words(lines: DataFrame) -> DataFrame:
    """lines with line (MD5 of the words; null without words) and w (words) in place of said."""
    rest = [c for c in lines.columns if c != "said"]
    split = lines.select(*rest, F.array_remove(F.split(F.lower("said"), "[^a-z0-9\\p{L}\\p{N}]+"), "").alias("w"))
    return split.select(*rest, F.when(F.size("w") > 0, F.unhex(F.md5(F.array_join("w", " ")))).alias("line"), "w")


def with_tokens(lines: DataFrame) -> DataFrame:
    """lines with tokens in place of w: words are hashed once, their runs again."""
    rest = [c for c in lines.columns if c != "w"]
    hashed = lines.select(*rest, F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    n = F.size("h")
    runs = F.transform(F.sequence(F.lit(0), n - SHINGLE_WORDS), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(SHINGLE_WORDS)]))
    tokens = F.when(n >= SHINGLE_WORDS, F.array_distinct(runs)).when(n > 0, F.array(F.xxhash64("h"))).otherwise(F.array().cast("array<bigint>"))
    return hashed.select(*rest, tokens.alias("tokens"), (n >= SHINGLE_WORDS).alias("runs"))


def probe_length(n: Column, similarity: float) -> Column:
    """Prefix in which a line of n tokens shares one with any similar line."""
    return (n - F.ceil(n * similarity - 1e-9) + 1).cast("int")


def index_length(n: Column, similarity: float) -> Column:
    """Prefix in which it shares one with any similar line that is not shorter."""
    return (n - F.ceil(n * (2 * similarity / (1 + similarity)) - 1e-9) + 1).cast("int")


def prefix_shares(n: Column) -> Column:
    """Tokens that the prefixes of two similar lines share, the shorter of which has n tokens, if both are longer by one
    less than what this gives for their own number of tokens."""
    return F.lit(1) + F.floor(n / TOKENS_A_SHARE).cast("int")


def fewest(similarity: float) -> int:
    """Tokens of a set that can be similar to a different one: m / (m + 1) is the most there is."""
    return math.ceil(similarity / (1 - similarity) - 1e-9) if similarity < 1 else 1 << 30


def _looked_up(df: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """A written table as the side of a join: broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= most else df


def searched_lines(rows: DataFrame, similarity: float) -> DataFrame:
    """raw, of the lines that share enough tokens of their prefix, in the order of hashes, with other lines. Copies of a
    line are told from other lines by a hash, so that they need no joining here. The shortest line that can be similar to
    one of n tokens has n * similarity, which bounds what the two must share."""
    n = F.col("n")
    held = rows.where(n >= fewest(similarity)).select(F.xxhash64("line").alias("id"), "row", "line_no", "raw", "n", F.posexplode("prefix").alias("place", "token"))
    indexed = F.col("place") < index_length(n, similarity) + prefix_shares(n) - 1
    shared = held.groupBy("token").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(indexed).alias("indexed")).where("lo != hi AND indexed")
    tokens = written(shared.select("token"), "shared-tokens")
    hits = held.select("row", "line_no", "raw", "n", "token").join(_looked_up(tokens), "token", "left_semi")
    lines = hits.groupBy("row", "line_no", "raw", "n").agg(F.count("*").alias("shared"))
    found = written(lines.where(F.col("shared") >= prefix_shares(F.ceil(n * similarity - 1e-9))).select("raw").distinct(), "searched")
    discard(tokens)
    return found


def token_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id (a number), line, n, tokens of the wanted lines. Copies of a line are joined before anything is shuffled."""
    held = raw_lines(docs).select("raw", "said").join(_looked_up(wanted), "raw", "left_semi").select("said")
    once = with_tokens(with_words(held)).groupBy("line").agg(F.first("tokens").alias("tokens"))
    return written(once.select(F.monotonically_increasing_id().alias("id"), "line", F.size("tokens").alias("n"), "tokens"), "token-sets")


def frequencies(sets: DataFrame) -> DataFrame:
    """token, frequency, of the tokens of several lines."""
    each = sets.select(F.explode("tokens").alias("token"))
    return written(each.groupBy("token").agg(F.count("*").alias("frequency")).where("frequency > 1"), "frequencies")


def widely_shared(sets: DataFrame, several: DataFrame, similarity: float) -> DataFrame:
    """The sets that can have a similar one: enough of their tokens, as a filter tells, are also in another."""
    found = possible(sets.select("id", "n", F.explode("tokens").alias("token")), "token", several)
    enough = found.groupBy("id", "n").agg(F.count("*").alias("shared")).where(F.col("shared") >= F.ceil(F.col("n") * similarity - 1e-9))
    wanted = written(enough.select("id"), "widely-shared")
    out = written(sets.join(_looked_up(wanted), "id", "left_semi"), "compared-sets")
    discard(wanted)
    return out


def token_bits() -> list[Column]:
    """For a group of tokens, two longs with a bit for each, by its hash."""
    bit, upper = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("token").bitwiseAND(63).cast("int")), F.col("token").bitwiseAND(64) != 0
    zero = F.lit(0).cast("long")
    return [F.bit_or(F.when(upper, zero).otherwise(bit)).alias("low"), F.bit_or(F.when(upper, bit).otherwise(zero)).alias("high")]


def postings(sets: DataFrame, several: DataFrame, similarity: float) -> DataFrame:
    """token, frequency, id, n, place (from 1), own (tokens of no other line), low, high, before: the prefixes in the
    order of rarity, without the tokens of a single line, which come first."""
    held = sets.select("id", "n", F.explode("tokens").alias("token")).join(_looked_up(several), "token")
    order = F.sort_array(F.collect_list(F.struct("frequency", "token")))
    sorted_ = held.groupBy("id", "n").agg(order.alias("order"), *token_bits()).withColumn("own", F.col("n") - F.size("order"))
    prefix = F.slice("order", F.lit(1), F.greatest(probe_length(F.col("n"), similarity) - F.col("own"), F.lit(0)))
    listed = sorted_.select("id", "n", "own", "low", "high", prefix.alias("prefix")).where(F.size("prefix") > 0)
    carried = F.when(F.size("prefix") <= CARRIED, F.col("prefix.token"))
    found = listed.select("id", "n", "own", "low", "high", carried.alias("before"), F.posexplode("prefix").alias("at", "t"))
    return written(found.select("id", "n", "own", "low", "high", "before", (F.col("at") + F.col("own") + 1).alias("place"), "t.token", "t.frequency"), "postings")


def candidates(held: DataFrame, similarity: float) -> DataFrame:
    """a, b (ids): pairs that pass the filters, the shorter line found by its index prefix."""
    parts = F.ceil(F.col("frequency") / DEALT).cast("int")
    probing = held.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).alias("y")
    indexed = held.where(F.col("place") <= index_length(F.col("n"), similarity)).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).alias("x")
    shared = F.ceil((F.col("x.n") + F.col("y.n")) * (similarity / (1 + similarity)) - 1e-9)
    differ = F.bit_count(F.col("x.low").bitwiseXOR(F.col("y.low"))) + F.bit_count(F.col("x.high").bitwiseXOR(F.col("y.high")))
    first = F.element_at(F.array_intersect("x.before", "y.before"), 1) == F.col("x.token")
    fits = [
        F.col("x.token") == F.col("y.token"), F.col("x.part") == F.col("y.part"),
        (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id"))),
        F.col("x.n") >= F.col("y.n") * similarity - 1e-9,
        F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1 >= shared,
        F.col("x.own") + F.col("y.own") + differ <= F.col("x.n") + F.col("y.n") - 2 * shared,
        F.coalesce(first, F.lit(True)),
    ]
    return indexed.join(probing, fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) ids -> a, b (lines), similarity of the pairs that are similar enough. Only lines in a pair are looked up."""
    pairs = written(pairs, "line-pairs")
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "paired")
    held = written(sets.join(_looked_up(wanted), "id", "left_semi").select("id", "line", "tokens"), "paired-sets")
    side = lambda name: held.select(F.col("id").alias(name), F.struct("line", "tokens").alias(name + "_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_set.tokens", "b_set.tokens"))
    jaccard = both.select(F.col("a_set.line").alias("a"), F.col("b_set.line").alias("b"), (shared / (F.size("a_set.tokens") + F.size("b_set.tokens") - shared)).alias("similarity"))
    out = written(jaccard.where(F.col("similarity") >= similarity - 1e-9), "links")
    discard(pairs, wanted, held)
    return out


def equal_sets(lines: DataFrame) -> DataFrame:
    """line, first (place), leader (the line that comes first), others (number): different lines of the same few tokens."""
    held = lines.where("same IS NOT NULL").select("same", "line", "first")
    groups = held.groupBy("same").agg(F.min(F.struct("first", "line")).alias("least"), (F.count("*") - 1).alias("others")).where("others > 0")
    return held.join(groups, "same").select("line", "first", F.col("least.line").alias("leader"), "others")


def similar_lines(docs: DataFrame, key: str = "doc_id", similarity: float = SIMILARITY, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, links). rows: key, row, line_no, class_at (key and line_no of the class's first line; null without words),
    n_links (different lines that are similar), copies (equal lines, itself among them; null without words), removed.
    links: a, b (MD5 of their words), similarity; lines of the same few tokens only with the first of them.

    row names a column that numbers the rows of docs; without it they are numbered here."""
    numbered = docs.select(F.col(key).alias("doc"), (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), "text")
    n = F.size("tokens")
    hashed = with_tokens(with_words(raw_lines(numbered))).withColumns({"n": n, "prefix": F.when(n >= fewest(similarity), F.slice(F.sort_array("tokens"), F.lit(1), probe_length(n, similarity) + prefix_shares(n) - 1))})
    few = F.when(F.col("runs") & (n < fewest(similarity)), F.xxhash64(F.sort_array("tokens")))
    rows = written(hashed.select("doc", "row", "line_no", "raw", "line", "n", "prefix", few.alias("same")), "line-rows")

    searched = searched_lines(rows, similarity)
    every = token_sets(numbered, searched)
    several = frequencies(every)
    sets = widely_shared(every, several, similarity)
    discard(searched, every)
    held = postings(sets, several, similarity)
    pairs = verified(candidates(held, similarity), sets, similarity)
    discard(several, held, sets)

    place = F.struct("doc", "line_no", "row")
    lines = written(rows.where("line IS NOT NULL").groupBy("line").agg(F.count("*").alias("copies"), F.min(place).alias("first"), F.first("same").alias("same")), "lines")
    few_tokens = written(equal_sets(lines), "equal-sets")
    links = pairs.union(few_tokens.where("line != leader").select(F.col("leader").alias("a"), F.col("line").alias("b"), F.lit(1.0).alias("similarity")))

    # Lines of a link, with where they first stand, their number of links, and whether an earlier one is similar.
    ends = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct()
    firsts = written(lines.join(_looked_up(written(ends, "linked"), BROADCAST_ROWS), "line", "left_semi").select("line", "first"), "linked-firsts")
    side = lambda name: firsts.select(F.col("line").alias(name), F.col("first").alias(name + "_first"))
    ordered = pairs.join(side("a"), "a").join(side("b"), "b")
    a_later = F.col("a_first") > F.col("b_first")
    per_end = F.explode(F.array(F.struct(F.col("a").alias("line"), F.col("a_first").alias("first"), a_later.alias("later")), F.struct(F.col("b").alias("line"), F.col("b_first").alias("first"), (~a_later).alias("later"))))
    counted = ordered.select(per_end.alias("e")).select("e.*").groupBy("line", "first").agg(F.count("*").alias("n_links"), F.max("later").alias("later"))
    members = written(counted.union(few_tokens.select("line", "first", F.col("others").alias("n_links"), (F.col("line") != F.col("leader")).alias("later"))), "members")
    roots = components(links, "line-classes")
    linked = written(members.join(roots.withColumnRenamed("node", "line"), "line"), "classed")
    classes = linked.groupBy("root").agg(F.min("first").alias("class_at"))
    known = linked.join(classes, "root").select("line", "n_links", "later", "class_at")
    named = written(lines.select("line", "first", "copies").join(known, "line", "left").where("copies > 1 OR class_at IS NOT NULL"), "named")

    found = rows.select("doc", "row", "line_no", "line").join(_looked_up(named, BROADCAST_ROWS), "line", "left")
    worded = F.col("line").isNotNull()
    at = F.coalesce("class_at", "first", place)
    out = found.select(
        F.col("doc").alias(key), "row", "line_no",
        F.when(worded, F.struct(at["doc"].alias(key), at["line_no"].alias("line_no"))).alias("class_at"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(worded, F.coalesce("copies", F.lit(1))).alias("copies"),
        (worded & (F.coalesce("later", F.lit(False)) | (F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place)))).alias("removed"),
    )
    return out, links


def kept_texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text of every row of docs, without the lines that the join removes: empty where none is left, null where it
    was null. Rows are numbered first, so that equal ids stay apart."""
    numbered = written(docs.select(F.col(key).alias("doc"), "text").withColumn("row", F.monotonically_increasing_id()), "numbered")
    rows, _ = similar_lines(numbered, "doc", row="row")
    gone = rows.where("removed").groupBy("row").agg(F.collect_list("line_no").alias("gone"))
    split = numbered.join(gone, "row", "left").select(F.col("doc").alias(key), "text", F.col("gone").cast("array<int>").alias("gone"), F.split("text", "\n").alias("_lines"))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "gone"), lambda i: F.get("_lines", i))
    return split.select(key, F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = similar_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("class_at.doc_id").alias("class_doc_id"),
        F.col("class_at.line_no").cast("long").alias("class_line_no"), "n_links", "copies", "removed",
    )
