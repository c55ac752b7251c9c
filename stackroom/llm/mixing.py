"""Mixing sources to target weights along a training run.

Every source has a schedule, a weight over the run's time 0 to 1. Its integral, scaled to the source's target, is the
source's cumulative demand for words. Documents lie along that demand in the order of a hash, but for the largest, which
lead, pass after pass over the source; inverting the demand at the middle of a document's stretch gives its training
position, and the mix is range-sorted by position.

Defined cases: a null text has no words; a null source is a source of its own, after all others; documents without
words are taken once, with no words; repeated rows are separate documents; an empty table gives an empty mix; further
columns pass through, and plan_mix replaces those with names that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stackroom.llm.common import maybe_broadcast, running_sum, table, text_of, written

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a multiple of all words, and the most passes over one source.
SHARE, CAP = 1.5, 2
#: A document of more than 1 / LARGEST of its source's words is one of its largest: there are fewer than LARGEST.
LARGEST = 100
#: Weight over time as knots (time, weight), by position in WEIGHTS: the first fades, the last one grows.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.6, 1.0), (1.0, 1.75)))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09-0x0D."""
    parts = F.split(text, "[\\x20\\x09-\\x0D]+")
    blank = lambda x: F.when(x == "", 1).otherwise(0)
    last = F.when(F.size(parts) > 1, blank(F.element_at(parts, -1))).otherwise(0)
    return (F.size(parts) - blank(F.element_at(parts, 1)) - last).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) -> source, source_size, turn (its place in weights), target.

    Targets are in proportion to the weights but for sources at their cap; what those leave is shared out again. With
    the sources in the order of cap / weight, the capped ones come first, so running sums give the common level. The
    input has one row a source: a dimension table, the only thing here that passes a window without partitions.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    rows = sizes.withColumn("turn", turn).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("turn") + 1).cast("double"))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    upto, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(every) * F.lit(float(share))
    left = F.greatest(total - F.coalesce(F.sum("most").over(upto), F.lit(0.0)), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    rows = rows.withColumn("level", left / weight_left)
    # The level is that of the first source, in this order, which it leaves at or below its cap.
    within = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    level = F.first(within, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("most"), F.coalesce(level * F.col("weight"), F.col("most")))
    return rows.withColumn("target", target).select("source", "source_size", "turn", "target")


def position_at(share_of_target: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """Inverse of a schedule's normalised integral: the time by which this share of the target has been asked for."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, before, out = sum(areas), sum(areas), None
    for (t0, w0), (t1, w1), area in reversed([(*ab, s) for ab, s in zip(zip(knots, knots[1:], strict=False), areas, strict=True)]):
        before -= area
        need = F.greatest(share_of_target * F.lit(whole) - F.lit(before), F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        # need = w0 x + slope x^2 / 2, solved in the form that stays stable for a slope near 0
        x = F.lit(2.0) * need / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(1e-18))))
        at = F.least(F.lit(t0) + x, F.lit(t1))
        out = at if out is None else F.when(share_of_target * F.lit(whole) < F.lit(before + area), at).otherwise(out)
    return out


def plan_mix(docs: DataFrame, key: str = "doc_id", schedules=SCHEDULES, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """docs (key, source, size, ...) with source_size, target, copies, and positions (one a copy, ascending)."""
    rest = [c for c in docs.columns if c not in ("source_size", "target", "copies", "positions")]
    named = docs.select(F.col(key).alias("_key"), "source", "size", F.struct(*rest).alias("_row"))
    named = named.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).withColumn("_hash", F.xxhash64("_key", "size"))
    sizes = named.groupBy("_source", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes.drop("_source"), weights, share, cap).withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    # A source's few largest documents come first, by size, so that the cut at its target falls between small ones.
    # The targets are one row a source; broadcast, they leave a hot source's rows where they are.
    targets = written(targets, "targets")
    sized = named.join(maybe_broadcast(targets.drop("source"), targets.count()), "_source")
    first = F.when(F.col("size") * LARGEST > F.col("source_size"), ((1 - F.col("size") / F.col("source_size")) * (1 << 51)).cast("long")).otherwise(F.col("_hash"))
    rows = running_sum(sized.withColumn("_hash", first), ["_source"], "_hash", F.col("size"), "_from", ["_key"])
    middle = lambda turn: F.col("_from") + F.col("source_size") * turn + F.col("size") / 2
    taken = F.filter(F.sequence(F.lit(0), F.lit(cap - 1)), lambda turn: (middle(turn) <= F.col("target")) | ((turn == 0) & (F.col("size") == 0)))

    def position(turn: Column) -> Column:
        asked = F.when(F.col("target") > 0, F.least(middle(turn) / F.col("target"), F.lit(1.0))).otherwise(F.lit(0.0))
        out = F.lit(None).cast("double")
        for i in range(len(weights)):
            out = F.when(F.col("turn") == i, position_at(asked, schedules[i])).otherwise(out)
        return out

    return rows.withColumn("positions", F.transform(taken, position)).select("_row.*", "source_size", "target", F.size("positions").alias("copies"), "positions")


def mix(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """row (a struct of docs' columns) and position for every copy that the mix takes, range-sorted by position."""
    sized = docs.select(F.col(key).alias("key"), "source", word_count(text_of()).alias("size"), F.struct(*docs.columns).alias("row"))
    plan = plan_mix(sized, "key", **options)
    return plan.select("key", "row", F.explode("positions").alias("position")).orderBy("position", "key").select("row", "position")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(text_of()).alias("size"))
    plan = plan_mix(written(sized, "sizes"))
    first = F.try_element_at("positions", F.lit(1))
    return plan.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), first.alias("position")
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix's documents in training order, repeats as repeated rows."""
    return mix(docs).select("row.*")
