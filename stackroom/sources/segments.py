"""A full-text index of segments: searches read the bounds of their terms' blocks first, and then only blocks that count.

Documents are dealt to blocks by their groups (columns such as the library, which searches filter by), their size class and a
hash, so that the documents of a block are of about one length, and many or few occurrences come in blocks of their own.
A term's postings in a block are one row, with the greatest weight among them (`best`) and, with positions, the most occurrences (`most`).
The sum of these over a query's terms bounds the score of every document in the block.

    blocks/segment=S/bucket=B     term, groups, block, n, best, most, ids, weights, and spots if the index has positions
    bounds/segment=S/bucket=B     the same without the arrays
    terms/segment=S/bucket=B      term, df
    documents/segment=S/slice=P   key, size, terms, if the index takes updates
    dead/batch=N                  segment, key: documents of earlier segments that batch N replaced or deleted
    corrections/batch=N           segment, term, df: what these no longer count
    versions/N                    the segments and batches that make version N

A batch of changed documents becomes a segment of its own. Where FANOUT segments are of one size class they are merged, and
one of which half is dead is written anew, so that there are few in the logarithm of the documents. A version is written
last: a reader sees all of a batch or nothing, and a batch that is repeated changes nothing. One writer at a time.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackroom.functions.analyze import LABEL_WEIGHTS
from stackroom.operators.relational import if_small
from stackroom.sources.stored import delete_below, folder_of, latest_state, publish, python_path, settings

BUCKETS, SLICES = 16, 16
#: Documents of a block; tasks among which the merged blocks of one bucket are dealt; size classes in a power of two.
DOCS_PER_BLOCK, DEALT, CLASSES = 1024, 4, 4
#: Sizes of a block's documents together, about: what a task that makes its postings holds. Long documents are fewer a block.
BLOCK_SIZE = 16 << 20
#: Segments of one level that are merged, and the documents of the lowest level.
FANOUT, LEAST_DOCS = 4, 1000
_CLASS_BITS = 40


@dataclass(frozen=True)
class Segment:
    name: str
    docs: int
    dead: int = 0

    @property
    def level(self) -> int:
        return max(0, math.floor(math.log(max(self.docs, 1) / LEAST_DOCS, FANOUT))) if self.docs > LEAST_DOCS else 0


@dataclass(frozen=True)
class Snapshot:
    """One version of an index."""

    spark: SparkSession = field(repr=False)
    path: str
    key: str
    groups: tuple[str, ...] = ()
    buckets: int = BUCKETS
    positions: bool = False
    updates: bool = False
    docs_per_block: int = DOCS_PER_BLOCK
    key_type: str = "bigint"
    version: int = 0
    batch: int = -1
    segments: tuple[Segment, ...] = ()
    dead_batches: tuple[int, ...] = ()

    def _read(self, kind: str, names: list[str] | None = None) -> DataFrame:
        names = [s.name for s in self.segments] if names is None else names
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/segment={n}" for n in names])

    def of_terms(self, kind: str, words: list[str] | None) -> DataFrame:
        """Rows of a table for these words; without words, of all."""
        rows = self._read(kind)
        if words is None:
            return rows
        places = sorted({zlib.crc32(w.encode()) % self.buckets for w in words})
        return rows.where(F.col("bucket").isin(places) & F.col("term").isin(words))

    def dead(self) -> DataFrame | None:
        """segment, key of documents that don't count any more; None if all do."""
        if not any(s.dead for s in self.segments):
            return None
        rows = self.spark.read.parquet(*[f"{self.path}/dead/batch={n}" for n in self.dead_batches])
        return rows.where(F.col("segment").isin([s.name for s in self.segments]))

    def alive(self, rows: DataFrame) -> DataFrame:
        """rows (segment, key, ...) of documents that count."""
        gone = self.dead()
        return rows if gone is None else rows.join(if_small(gone, sum(s.dead for s in self.segments)), ["segment", self.key], "left_anti")

    def exploded(self, blocks: DataFrame) -> DataFrame:
        """term, groups, block, key, weight, and spots if there are any: a row for each document of the blocks."""
        columns = ["ids", "weights", *(["spots"] if self.positions else [])]
        rows = blocks.select("segment", "term", *self.groups, "block", F.explode(F.arrays_zip(*columns)).alias("p"))
        rows = rows.select("segment", "term", *self.groups, "block", F.col("p.ids").alias(self.key), F.col("p.weights").alias("weight"), *(["p.spots"] if self.positions else []))
        return self.alive(rows).drop("segment")

    def postings(self, blocks: DataFrame | None = None) -> DataFrame:
        """key, term, pos, label of the documents of these blocks, or of all."""
        each = self.exploded(self.of_terms("blocks", None) if blocks is None else blocks)
        return each.select(self.key, "term", F.explode("spots").alias("s")).select(self.key, "term", "s.pos", "s.label")

    def document_frequencies(self, words: list[str] | None = None) -> DataFrame:
        """term, df (documents that hold it), without a look at any posting."""
        counted = self.of_terms("terms", words).select("term", "df")
        if any(s.dead for s in self.segments):
            less = self.spark.read.parquet(*[f"{self.path}/corrections/batch={n}" for n in self.dead_batches])
            less = less.where(F.col("segment").isin([s.name for s in self.segments]))
            counted = counted.union((less if words is None else less.where(F.col("term").isin(words))).select("term", -F.col("df")))
        return counted.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    @property
    def docs(self) -> int:
        return sum(s.docs - s.dead for s in self.segments)


def _publish(snapshot: Snapshot) -> Snapshot:
    made = replace(snapshot, version=snapshot.version + 1)
    state = {k: v for k, v in made.__dict__.items() if k not in ("spark", "path")} | {"segments": [s.__dict__ for s in made.segments]}
    publish(made.spark, made.path, made.version, state)
    return made


def create(spark: SparkSession, path: str, key: str, groups: tuple[str, ...] = (), **options) -> Snapshot:
    """An empty index. options: buckets, positions (for phrases and strict search), updates, docs_per_block, key_type."""
    return _publish(Snapshot(spark, path, key, tuple(groups), **options))


def latest(spark: SparkSession, path: str) -> Snapshot:
    """The newest version that was written to its end."""
    state = latest_state(spark, path)
    lists = {"groups": tuple(state["groups"]), "segments": tuple(Segment(**s) for s in state["segments"]), "dead_batches": tuple(state["dead_batches"])}
    return Snapshot(spark, path, **(state | lists))


def _size_class(size: Column) -> Column:
    return F.floor(F.log2(F.greatest(size, F.lit(1))) * CLASSES).cast("long")


def _block(size_class: Column, key: str, docs: dict[int, int], per_block: int) -> Column:
    """A class's documents go to as many blocks as they fill; docs has a few hundred classes at most."""
    parts = F.lit(1)
    for number, n in docs.items():
        fit = max(1, min(per_block, int(BLOCK_SIZE / 2 ** ((number + 1) / CLASSES))))
        if n > fit:
            parts = F.when(size_class == number, F.lit(-(-n // fit))).otherwise(parts)
    return F.shiftleft(size_class, _CLASS_BITS) + F.pmod(F.xxhash64(key), parts)


def _classes(rows: DataFrame) -> dict[int, int]:
    return {r[0]: r[1] for r in rows.groupBy("_class").agg(F.count("*").alias("n")).collect()}


def _postings_of_block(docs: pa.Table, key: str, groups: list[str], positions: bool) -> pa.Table:
    """A block's documents (key, groups, block, terms, labels, and pos with positions) -> a row of postings for each term."""
    docs = docs.take(pc.sort_indices(docs.column(key))).combine_chunks()
    terms, labels = (docs.column(c).combine_chunks() for c in ("terms", "labels"))
    coded, marks = terms.flatten().dictionary_encode(), labels.flatten().dictionary_encode()
    code, row = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(docs.num_rows), pc.list_value_length(terms).to_numpy())
    worth = np.array([LABEL_WEIGHTS.get(x, 0.0) for x in marks.dictionary.to_pylist()])[marks.indices.to_numpy()] if len(code) else np.zeros(0)
    # By term and document; the words of a document stay in order.
    place = code * docs.num_rows + row
    order = np.argsort(place, kind="stable")
    place = place[order]
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    term = place[starts] // max(docs.num_rows, 1)
    firsts = np.flatnonzero(np.diff(term, prepend=-1))
    weights = np.add.reduceat(worth[order], starts) if len(starts) else np.zeros(0)
    n, cuts = np.diff(starts, append=len(place)), pa.array(np.append(firsts, len(starts)), pa.int32())
    greatest = lambda x: np.maximum.reduceat(x, firsts) if len(firsts) else x
    held = lambda values: pa.ListArray.from_arrays(cuts, values)
    out = {"term": coded.dictionary.take(pa.array(term[firsts]))} | {c: pa.repeat(docs.column(c)[0], len(firsts)) for c in [*groups, "block"]}
    out |= {"n": pa.array(np.diff(firsts, append=len(starts)), pa.int32()), "best": pa.array(greatest(weights)), "most": pa.array(greatest(n), pa.int32())}
    out |= {"ids": held(docs.column(key).combine_chunks().take(pa.array(row[order[starts]]))), "weights": held(pa.array(weights))}
    if positions:
        spot = pa.StructArray.from_arrays([docs.column("pos").combine_chunks().flatten().take(pa.array(order)), labels.flatten().take(pa.array(order))], ["pos", "label"])
        out["spots"] = held(pa.ListArray.from_arrays(pa.array(np.append(starts, len(place)), pa.int32()), spot))
    return pa.table(out)


def _block_rows(placed: DataFrame, snapshot: Snapshot, words: Column | str = "words") -> DataFrame:
    """term, groups, block, n, best, most, ids, weights, spots of documents (key, groups, block, and what words are made of). A
    block's documents meet in one task, in which their words are made, so that texts are shuffled and no posting is."""
    key, groups, positions = snapshot.key, list(snapshot.groups), snapshot.positions
    python_path(snapshot.spark)
    kind = {f.name: f.dataType.simpleString() for f in placed.select(key, *groups, "block").schema.fields}
    columns = ["term string", *(f"`{c}` {kind[c]}" for c in [*groups, "block"]), f"n int, best double, most int, ids array<{kind[key]}>, weights array<double>"]
    columns += ["spots array<array<struct<pos:bigint,label:string>>>"] if positions else []

    def postings_of_block(docs: pa.Table) -> pa.Table:
        return _postings_of_block(docs, key, groups, positions)

    # Of a fixed number, as words are many times the texts by whose size Spark would join partitions.
    parts = int(snapshot.spark.conf.get("spark.sql.shuffle.partitions"))
    made = placed.repartition(parts, *groups, "block").select(key, *groups, "block", (F.col(words) if isinstance(words, str) else words).alias("words"))
    words = made.select(key, *groups, "block", F.col("words.term").alias("terms"), F.col("words.label").alias("labels"), *([F.col("words.pos").alias("pos")] if positions else []))
    return words.groupBy(*groups, "block").applyInArrow(postings_of_block, ", ".join(columns))


def _gathered(terms: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The same of postings: groups, block, key, term, weight, n, spots."""
    posting = F.struct(F.col(snapshot.key).alias("id"), "weight", "n", *(["spots"] if snapshot.positions else []))
    dealt = _dealt(terms, snapshot)
    grouped = dealt.groupBy("bucket", "_deal", "term", "block", *snapshot.groups).agg(F.sort_array(F.collect_list(posting)).alias("p"))
    return grouped.select(
        "bucket", "_deal", "term", *snapshot.groups, "block", F.size("p").alias("n"), F.array_max("p.weight").alias("best"), F.array_max("p.n").alias("most"),
        F.col("p.id").alias("ids"), F.col("p.weight").alias("weights"), *([F.col("p.spots").alias("spots")] if snapshot.positions else []),
    )


def _placed(rows: DataFrame, snapshot: Snapshot) -> DataFrame:
    bucket = F.pmod(F.crc32(F.encode("term", "UTF-8")), F.lit(snapshot.buckets)).cast("int")
    return rows.withColumn("bucket", bucket).withColumn("_deal", F.pmod(F.xxhash64("block"), F.lit(DEALT)))


def _dealt(rows: DataFrame, snapshot: Snapshot) -> DataFrame:
    return _placed(rows, snapshot).repartition("bucket", "_deal")


def _write_segment(snapshot: Snapshot, row: DataFrame, name: str) -> bool:
    """row: bucket, _deal, and a block's postings of a term. Each task writes its part of every bucket that it has, sorted.
    False if there are no terms, and so no segment."""
    path, groups = snapshot.path, list(snapshot.groups)
    # Grouped by sorting, merged rows are in the order of the files already.
    with settings(snapshot.spark, {"spark.sql.execution.useObjectHashAggregateExec": "false"}):
        row.sortWithinPartitions("bucket", "_deal", "term", "block").drop("_deal").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks/segment={name}")
    files, folder = folder_of(snapshot.spark, f"{path}/blocks/segment={name}")
    if not any(f.isDirectory() for f in files.listStatus(folder)):
        return False
    bounds = snapshot._read("blocks", [name]).select("bucket", "term", *groups, "block", "n", "best", "most")
    bounds.repartition("bucket").sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/bounds/segment={name}")
    summed = snapshot._read("bounds", [name]).groupBy("bucket", "term").agg(F.sum("n").alias("df"))
    summed.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms/segment={name}")
    return True


def _slice(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(SLICES)).cast("int")


def _retire(snapshot: Snapshot, keys: DataFrame, batch: int) -> Snapshot:
    """The version without what it holds of these keys: their documents are dead, and document frequencies are less."""
    if not snapshot.segments:
        return snapshot
    keys = keys.select(snapshot.key).distinct().withColumn("slice", _slice(snapshot.key))
    slices = [r[0] for r in keys.select("slice").distinct().collect()]  # SLICES at most
    gone = snapshot.alive(snapshot._read("documents").where(F.col("slice").isin(slices)).join(keys, ["slice", snapshot.key], "left_semi"))
    gone.select("segment", snapshot.key).write.mode("overwrite").parquet(f"{snapshot.path}/dead/batch={batch}")
    counts = {r[0]: r[1] for r in snapshot.spark.read.parquet(f"{snapshot.path}/dead/batch={batch}").groupBy("segment").count().collect()}
    if not counts:
        return snapshot
    less = gone.select("segment", F.explode("terms").alias("term")).groupBy("segment", "term").agg(F.count("*").alias("df"))
    less.write.mode("overwrite").parquet(f"{snapshot.path}/corrections/batch={batch}")
    segments = tuple(replace(s, dead=s.dead + counts.get(s.name, 0)) for s in snapshot.segments)
    return replace(snapshot, segments=segments, dead_batches=(*snapshot.dead_batches, batch))


def _merged(snapshot: Snapshot, some: list[Segment]) -> Snapshot:
    """The version with these segments as one, without their dead documents."""
    names, name = [s.name for s in some], f"m{snapshot.version + 1}-{some[0].name}"
    of_these = replace(snapshot, segments=tuple(some))
    docs = of_these.alive(of_these._read("documents")).drop("segment")
    left = sum(s.docs - s.dead for s in some)
    rest = tuple(s for s in snapshot.segments if s.name not in names)
    if left:
        docs.repartition("slice").write.mode("overwrite").partitionBy("slice").parquet(f"{snapshot.path}/documents/segment={name}")
        size_class = F.shiftright("block", _CLASS_BITS)
        classes = _classes(snapshot._read("documents", [name]).select(_size_class(F.col("size")).alias("_class")))
        rows = of_these.exploded(of_these._read("blocks")).withColumn("block", _block(size_class, snapshot.key, classes, snapshot.docs_per_block))
        n = F.size("spots") if snapshot.positions else F.lit(0)
        if _write_segment(snapshot, _gathered(rows.withColumn("n", n), snapshot), name):
            rest = (*rest, Segment(name, left))
    return replace(snapshot, segments=rest)


def compacted(snapshot: Snapshot) -> Snapshot:
    """The version after the merges that are due."""
    while True:
        levels: dict[int, list[Segment]] = {}
        for s in snapshot.segments:
            levels.setdefault(s.level, []).append(s)
        due = next((some for some in levels.values() if len(some) >= FANOUT), None) or next(([s] for s in snapshot.segments if 2 * s.dead > s.docs), None)
        if due is None:
            return snapshot
        snapshot = _merged(snapshot, due)


def update(snapshot: Snapshot, rows: DataFrame, batch: int, deleted: DataFrame | None = None, words: Column | str = "words") -> Snapshot:
    """The next version: with rows (key, groups, size, words: array of (term, pos, label)), one a key, in place of what the
    index held of their keys, and without the keys of `deleted`. A batch that the index already holds is left out. words may
    be an expression over columns of rows: then it is these that are shuffled."""
    if batch <= snapshot.batch:
        return snapshot
    if not snapshot.updates and snapshot.segments:
        raise ValueError("this index was made without updates")
    key, groups, name = snapshot.key, list(snapshot.groups), f"b{batch}"
    words = F.col(words) if isinstance(words, str) else words
    after = snapshot
    if snapshot.updates:
        after = _retire(snapshot, rows.select(key) if deleted is None else rows.select(key).union(deleted.select(key)), batch)
    if snapshot.updates:
        docs = rows.select(key, "size", F.array_distinct(words["term"]).alias("terms"), _slice(key).alias("slice"))
        docs.write.mode("overwrite").partitionBy("slice").parquet(f"{snapshot.path}/documents/segment={name}")
    classes = _classes(rows.select(_size_class(F.col("size")).alias("_class")))
    if classes:
        placed = rows.withColumn("block", _block(_size_class(F.col("size")), key, classes, snapshot.docs_per_block))
        if _write_segment(snapshot, _placed(_block_rows(placed, snapshot, words), snapshot), name):
            after = replace(after, segments=(*after.segments, Segment(name, sum(classes.values()))))
    return _publish(compacted(replace(after, batch=batch)))


def vacuum(snapshot: Snapshot) -> None:
    """Deletes what only versions before this one read."""
    live = {f"segment={s.name}" for s in snapshot.segments}
    for kind in ("blocks", "bounds", "terms", "documents"):
        delete_below(snapshot.spark, f"{snapshot.path}/{kind}", lambda name: name in live)
    delete_below(snapshot.spark, f"{snapshot.path}/versions", lambda name: name >= f"{snapshot.version:012d}")
