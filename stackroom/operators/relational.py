"""Reusable relational operations of the document collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: A side is broadcast up to so many rows.
BROADCAST_ROWS = 200_000


def if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a broadcast side if it has few enough rows, which are counted unless they are known; else Spark chooses."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


# --- predicates ------------------------------------------------------------------------------------------------------


def equals_ignoring_case(column: str, value: str) -> Column:
    return F.lower(column) == value.lower()


def contains_ignoring_case(column: str, value: str) -> Column:
    return F.lower(column).contains(value.lower())


def blank(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == "")


def json_contains(column: str, part: dict[str, str]) -> Column:
    """All of part's keys have their values in a JSON object column."""
    out = F.lit(True)
    for key, value in part.items():
        out = out & (F.get_json_object(column, f"$.{key}") == value)
    return F.coalesce(out, F.lit(False))


def json_has_key(column: str, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(column), key), F.lit(False))


def active(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.where(F.col(column).isNull())


def violations(df: DataFrame, rule: str, key: Column, wrong: Column) -> DataFrame:
    """rule, key (as text) of the rows for which a rule doesn't hold."""
    return df.where(wrong).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def duplicate_keys(df: DataFrame, rule: str, keys: list[str]) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return twice.select(F.lit(rule).alias("rule"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"))


def orphans(df: DataFrame, rule: str, foreign: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Foreign keys without a parent, once each."""
    known = parent.select(F.col(parent_key).alias(foreign))
    return df.select(foreign).where(F.col(foreign).isNotNull()).distinct().join(known, foreign, "left_anti").select(F.lit(rule).alias("rule"), F.col(foreign).cast("string").alias("key"))


def reject_reason(text: Column, least: int = 2, most: int = 500) -> Column:
    """Why a query text can't be searched, or null. Boolean keywords are whole upper-case words."""
    return (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "blank")
        .when(F.length(F.trim(text)) < least, "too short")
        .when(F.length(text) > most, "too long")
        .when(text.rlike(r"\b(AND|OR|NOT)\b"), "boolean keyword")
    )


# --- joins -----------------------------------------------------------------------------------------------------------


#: Dyadic levels of positions: up to 2**61 cells.
LEVELS = 62


def dyadic_nodes(start: Column, end: Column, levels: int) -> Column:
    """The fewest dyadic stretches that make up [start, end): array of (level, node), a node being the cells from
    node * 2**level on, as many as 2**level. There are at most two of a level, so some 2 log2(end - start)."""
    ks = F.sequence(F.lit(0), F.lit(levels - 1))
    # At level k the stretch is [ceil(start / 2**k), floor(end / 2**k)); an odd end on either side has no pair and is taken.
    low = lambda k: -F.call_function("shiftright", -start, k)
    high = lambda k: F.call_function("shiftright", end, k)
    node = lambda k, n, taken: F.when(taken, F.struct(k.cast("int").alias("level"), n.alias("node")))
    odd = lambda n: n.bitwiseAND(1) == 1
    both = F.flatten(F.transform(ks, lambda k: F.array(
        node(k, low(k), (low(k) < high(k)) & odd(low(k))), node(k, high(k) - 1, (low(k) < high(k)) & odd(high(k))),
    )))
    return F.filter(both, lambda x: x.isNotNull())


def range_join_dyadic(points: DataFrame, at: str, intervals: DataFrame, start: str, end: str, on: str | None = None, width: float = 1) -> DataFrame:
    """Points within [start, end), of the same key if `on` names one. Positions are cut into cells of `width`.

    An interval is laid over the few dyadic stretches that make it up, whatever its length, and a point asks for the
    stretches that its cell is in, one of each level that occurs. So both sides have a bounded number of rows, the join has
    equal keys, and no pair comes twice.
    """
    scaled = lambda c: F.col(c) / F.lit(width) if width != 1 else F.col(c)
    cell, past = lambda c: F.floor(scaled(c)).cast("long"), F.ceil(scaled(end)).cast("long")
    cut = intervals.where(F.col(start) < F.col(end)).withColumn("_x", F.explode(dyadic_nodes(cell(start), past, LEVELS)))
    cut = cut.withColumns({"_level": F.col("_x.level"), "_node": F.col("_x.node")}).drop("_x")
    held = dict(map(tuple, cut.groupBy("_level").count().collect()))  # LEVELS at most
    # The longest stretches, which meet the most points, are broadcast as far as they are few.
    coarse, room = [], BROADCAST_ROWS
    for level in sorted(held, reverse=True):
        room -= held[level]
        if room < 0:
            break
        coarse.append(level)

    def joined(rows: DataFrame, levels: list[int], side: DataFrame) -> DataFrame:
        asks = F.transform(F.array(*[F.lit(k) for k in levels]), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", cell(at), k).alias("node"))) if levels else F.array().cast("array<struct<level:int,node:bigint>>")
        asked = rows.withColumn("_x", F.explode(asks)).withColumns({"_level": F.col("_x.level"), "_node": F.col("_x.node")}).drop("_x")
        both = asked.join(side, [*([on] if on else []), "_level", "_node"])
        return both.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_node")

    fine = sorted(set(held) - set(coarse))
    shuffled = joined(points, fine, cut.where(F.col("_level").isin(fine)))
    if not coarse:
        return shuffled
    # Dealt, as a small file of points may have very many partners.
    dealt = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = joined(dealt, coarse, F.broadcast(cut.where(F.col("_level").isin(coarse))))
    return spread.unionByName(shuffled) if fine else spread


def gaps(df: DataFrame, group: str, ordinal: str) -> DataFrame:
    """Rows above ordinal 1 whose predecessor is missing."""
    before = F.lag(ordinal).over(Window.partitionBy(group).orderBy(ordinal))
    return df.withColumn("_before", before).where((F.col(ordinal) > 1) & ((F.col("_before") != F.col(ordinal) - 1) | F.col("_before").isNull())).drop("_before")


def with_exists(df: DataFrame, other: DataFrame, on: str, flag: str) -> DataFrame:
    """df with a flag that says whether `other` has the key."""
    known = other.select(on).distinct().withColumn("_known", F.lit(True))
    return df.join(known, on, "left").withColumn(flag, F.col("_known").isNotNull()).drop("_known")


# --- aggregates and windows ------------------------------------------------------------------------------------------


def next_ordinal(groups: DataFrame, key: str, rows: DataFrame, foreign: str, ordinal: str) -> DataFrame:
    """key, next_ordinal: 1 for groups without rows."""
    last = rows.groupBy(F.col(foreign).alias(key)).agg(F.max(ordinal).alias("_last"))
    return groups.select(key).join(last, key, "left").select(key, (F.coalesce("_last", F.lit(0)) + 1).cast("long").alias("next_ordinal"))


#: Values of an order that one piece of a group spans: a group of whole ordinals has no more rows in a task.
PIECE = 8192


def _in_pieces(df: DataFrame, group: str, order: str, piece: int) -> tuple[DataFrame, Window]:
    """df with _group and _piece, and a window over the rows of a piece up to each one. Pieces are scanned alone; what goes
    from one to the next is found by a second pass over one row a piece. The order is a number."""
    at = F.coalesce(F.floor(F.col(order) / piece), F.lit(-(1 << 62)))
    return df.withColumn("_group", F.struct(group)).withColumn("_piece", at), Window.partitionBy("_group", "_piece").orderBy(order)


def _pieces_before() -> Window:
    return Window.partitionBy("_group").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)


def neighbours(df: DataFrame, group: str, ordinal: str, column: str, piece: int = PIECE) -> DataFrame:
    """The values of the rows before and after; a hot group is scanned in pieces."""
    rows, inside = _in_pieces(df, group, ordinal, piece)
    value, by_piece = F.struct(F.col(column).alias("v")), Window.partitionBy("_group").orderBy("_piece")
    ends = rows.groupBy("_group", "_piece").agg(F.min_by(value, ordinal).alias("_first"), F.max_by(value, ordinal).alias("_last"))
    ends = ends.select("_group", "_piece", F.lag("_last").over(by_piece).alias("_earlier"), F.lead("_first").over(by_piece).alias("_later"))
    near = rows.withColumns({"_lag": F.lag(value).over(inside), "_lead": F.lead(value).over(inside)}).join(ends, ["_group", "_piece"])
    found = near.withColumns({f"previous_{column}": F.coalesce("_lag", "_earlier")["v"], f"next_{column}": F.coalesce("_lead", "_later")["v"]})
    return found.drop("_group", "_piece", "_lag", "_lead", "_earlier", "_later")


def running_total(df: DataFrame, group: str, order: str, value: Column, out: str, piece: int = PIECE) -> DataFrame:
    """df with the sum of value over the group's rows up to each one; a hot group is scanned in pieces."""
    rows, inside = _in_pieces(df.withColumn("_value", value), group, order, piece)
    sums = rows.groupBy("_group", "_piece").agg(F.sum("_value").alias("_sum"))
    starts = sums.select("_group", "_piece", F.coalesce(F.sum("_sum").over(_pieces_before()), F.lit(0)).alias("_start"))
    summed = rows.withColumn("_here", F.coalesce(F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return summed.join(starts, ["_group", "_piece"]).withColumn(out, F.col("_start") + F.col("_here")).drop("_group", "_piece", "_value", "_here", "_start")


def context_window(df: DataFrame, group: str, ordinal: str, column: str, around: int) -> DataFrame:
    """The values of up to `around` ordinals before and after each row, in order."""
    near = Window.partitionBy(group).orderBy(ordinal).rangeBetween(-around, around)
    return df.withColumn("context", F.collect_list(column).over(near))


def latest_per(df: DataFrame, group: str, order: list[Column], n: int = 1) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def reassign(df: DataFrame, key: str, ordinal: str, mapping: DataFrame) -> DataFrame:
    """New ordinals where mapping (key, new_ordinal) has them."""
    return df.join(mapping, key, "left").withColumn(ordinal, F.coalesce("new_ordinal", ordinal)).drop("new_ordinal")


def carry_forward(df: DataFrame, group: str, order: str, levels: list[str], piece: int = PIECE) -> DataFrame:
    """Each level's last value so far, as level_now; a new value of an outer level clears the inner ones.

    What a row says of a level is its value, or that an outer level's value clears it, or nothing. A piece's rows carry on
    what was said last in the piece; where nothing was, what was said last in the pieces before holds.
    """
    said = {f"_said{i}": F.when(F.col(level).isNotNull(), F.struct(F.col(level).alias("v"))) for i, level in enumerate(levels)}
    for i in range(1, len(levels)):
        cleared = F.struct(F.lit(None).cast(df.schema[levels[i]].dataType).alias("v"))
        outer = F.coalesce(*[F.when(F.col(level).isNotNull(), F.lit(1)) for level in levels[:i]])
        said[f"_said{i}"] = F.coalesce(said[f"_said{i}"], F.when(outer.isNotNull(), cleared))
    rows, inside = _in_pieces(df.withColumns(said), group, order, piece)
    last = rows.groupBy("_group", "_piece").agg(*[F.max_by(s, F.when(F.col(s).isNotNull(), F.col(order))).alias(s) for s in said])
    before = last.select("_group", "_piece", *[F.last(s, ignorenulls=True).over(_pieces_before()).alias(f"{s}_before") for s in said])
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.withColumns({f"{s}_here": F.last(s, ignorenulls=True).over(upto) for s in said}).join(before, ["_group", "_piece"])
    now = {f"{level}_now": F.coalesce(f"_said{i}_here", f"_said{i}_before")["v"] for i, level in enumerate(levels)}
    return carried.withColumns(now).drop("_group", "_piece", *[f"{s}{end}" for s in said for end in ("", "_here", "_before")])


def sessions(df: DataFrame, group: str, order: str, gap: int) -> DataFrame:
    """Number of the run of rows that are at most `gap` apart."""
    by = Window.partitionBy(group).orderBy(order)
    new = F.when(F.col(order) - F.lag(order).over(by) <= gap, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


Routine = Callable[[DataFrame], DataFrame]
