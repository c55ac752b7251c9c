"""Range joins by dyadic stretches and scans in pieces, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from stackroom.operators import relational as R


def test_dyadic_nodes_make_up_the_interval(spark):
    pick = random.Random(1)
    spans = [(0, 0), (5, 5), (7, 3), (0, 1), (-1, 1), (-8, 8), (3, 1 << 40), (-(1 << 33) - 5, 77)] + [tuple(sorted(pick.sample(range(-300, 300), 2))) for _ in range(60)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", R.dyadic_nodes(F.col("a"), F.col("b"), 62).alias("nodes")).collect()
    for r in rows:
        held = sorted((n.node << n.level, (n.node + 1) << n.level) for n in r.nodes)
        assert len(held) <= 2 * max(1, (r.b - r.a).bit_length())
        assert all(x[1] == y[0] for x, y in zip(held, held[1:])) and (not held) == (r.a >= r.b)
        assert not held or (held[0][0], held[-1][1]) == (r.a, r.b)


@pytest.mark.parametrize("width", [1, 3, 0.25])
def test_range_join_of_all_lengths(spark, width):
    pick = random.Random(2)
    points = [(i, pick.choice([pick.randint(-50, 50), pick.randint(-(10**9), 10**9)]) + (0 if width == 1 else pick.random()), i % 3) for i in range(300)]
    spans = []
    for i in range(80):
        lo = pick.randint(-60, 60)
        spans.append((i, float(lo), float(lo + pick.choice([0, -3, 1, 2, 17, 1000, 10**6, 10**9])), i % 3))
    p = spark.createDataFrame([(i, float(at), k) for i, at, k in points] + [(999, None, 1)], "i long, at double, k long")
    s = spark.createDataFrame(spans + [(998, None, 1.0, 1), (997, 1.0, None, 1)], "j long, lo double, hi double, k long")
    got = sorted((r.i, r.j) for r in R.range_join_dyadic(p, "at", s.drop("k"), "lo", "hi", width=width).collect())
    assert got == sorted((i, j) for i, at, _ in points for j, lo, hi, _ in spans if lo <= at < hi)
    keyed = sorted((r.i, r.j) for r in R.range_join_dyadic(p, "at", s, "lo", "hi", "k", width).collect())
    assert keyed == sorted((i, j) for i, at, k in points for j, lo, hi, m in spans if k == m and lo <= at < hi)
    assert R.range_join_dyadic(p, "at", s.where("false"), "lo", "hi").isEmpty() and R.range_join_dyadic(p.where("false"), "at", s, "lo", "hi").isEmpty()


def rows_of(groups=4, n=90):
    pick = random.Random(3)
    out = []
    for g in [*range(groups), None]:
        for o in pick.sample(range(-20, 400), n):
            out.append((g, o, *(pick.choice([None] * k + [f"{name}{o}"]) for k, name in ((9, "a"), (4, "b"), (2, "c")))))
    return out


@pytest.mark.parametrize("piece", [1, 7, 64, 10**6])
def test_scans_in_pieces(spark, piece):
    rows = rows_of()
    df = spark.createDataFrame(rows, "g long, o long, a string, b string, c string")
    carried, before, total = {}, {}, {}
    for g in {r[0] for r in rows}:
        now, seen, mine = [None] * 3, 0, sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        for i, (_, o, *levels) in enumerate(mine):
            for k, v in enumerate(levels):
                if v is not None:
                    now[k:] = [v, *[None] * (2 - k)]
            seen += o
            carried[g, o], total[g, o] = tuple(now), seen
            before[g, o] = (mine[i - 1][2] if i else None, mine[i + 1][2] if i + 1 < len(mine) else None)
    got = R.carry_forward(df, "g", "o", ["a", "b", "c"], piece).collect()
    assert {(r.g, r.o): (r.a_now, r.b_now, r.c_now) for r in got} == carried and len(got) == len(rows)
    got = R.neighbours(df, "g", "o", "a", piece).collect()
    assert {(r.g, r.o): (r.previous_a, r.next_a) for r in got} == before and len(got) == len(rows)
    got = R.running_total(df, "g", "o", F.col("o"), "t", piece).collect()
    assert {(r.g, r.o): r.t for r in got} == total and len(got) == len(rows)
    assert R.carry_forward(df, "g", "o", ["a", "b"], piece).columns == [*df.columns, "a_now", "b_now"]


def test_a_hot_group_is_no_single_task(spark):
    df = spark.range(20_000).select(F.floor(F.col("id") / 10**6).alias("g"), F.col("id").alias("o"), F.when(F.col("id") % 1000 == 0, F.col("id")).alias("a"))
    carried = R.carry_forward(df.repartition(5), "g", "o", ["a"], 500)
    assert carried.where("a_now <> o - o % 1000 OR a_now IS NULL").isEmpty()
    plan = carried._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    # Only the pass over one row a piece is dealt by the group alone.
    assert sum("_piece" not in line for line in keys) == 1


def test_side_of_counted_size(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_ROWS", 5)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    assert hinted(R.if_small(spark.range(5))) and not hinted(R.if_small(spark.range(6))) and not hinted(R.if_small(spark.range(1), 6))


def test_long_stretches_are_broadcast_and_short_ones_shuffled(spark, monkeypatch):
    """Both sides of the bound give the same pairs, and the points of a long stretch are in many tasks."""
    points = spark.range(600).select("id", (F.col("id") * 37 % 1000).alias("at"))
    intervals = spark.range(60).select(F.col("id").alias("i"), (F.col("id") * 13 % 500).alias("lo")).withColumn("hi", F.col("lo") + F.when(F.col("i") % 10 == 0, 400).otherwise(3))
    want = {(p, i) for p in range(600) for i in range(60) if i * 13 % 500 <= p * 37 % 1000 < i * 13 % 500 + (400 if i % 10 == 0 else 3)}
    for bound in (0, 25, 1000):
        monkeypatch.setattr(R, "BROADCAST_ROWS", bound)
        made = R.range_join_dyadic(points, "at", intervals, "lo", "hi").select("id", "i")
        assert {tuple(r) for r in made.collect()} == want and made.count() == len(want)
    assert made.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
