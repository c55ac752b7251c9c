import random
import re

import pytest
from pyspark.sql import functions as F

from stackroom.llm import mixing as M


def targets_by_hand(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    names = sorted((n for n in sizes if n is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[n] for n in free)
        above = [n for n in free if level * w[n] > cap * sizes[n]]
        if not above:
            return fixed | {n: level * w[n] for n in free}
        fixed |= {n: float(cap * sizes[n]) for n in above}


def test_targets(spark):
    rng = random.Random(4)
    for trial in range(8):
        sizes = {f"s{i}": rng.choice([0, 1, 10, 1000, 50_000]) for i in range(rng.randrange(1, 12))} | ({None: 300} if trial % 2 else {})
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in M.source_targets(df).collect()}
        assert got == pytest.approx(targets_by_hand(sizes))


def test_word_count(spark):
    texts = ["", " ", "a", " a b ", "\ta\n\nb\x0bc\r", "é x y", "\x1c", "  x", "x" * 100_000 + " y"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "text string").select(M.word_count(F.col("text")).alias("n")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


def test_plan(spark, docs_of):
    rng = random.Random(1)
    docs = docs_of([(i, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "b", "b", None])) for i in range(900)])
    sized = docs.select("doc_id", "source", M.word_count(F.col("text")).alias("size"))
    rows = M.plan_mix(sized).collect()
    assert len(rows) == 900
    for source in ("a", "b", None):
        own = [r for r in rows if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 60
    assert all(0 <= r.copies <= 2 and r.positions == sorted(r.positions) and all(0 <= p <= 1 for p in r.positions) for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, M.plan_mix(sized.repartition(7)).collect()), key=str)


def test_schedule_is_inverted(spark):
    for knots in M.SCHEDULES:
        area = lambda t: sum((min(t, b[0]) - a[0]) * (a[1] + a[1] + (b[1] - a[1]) * (min(t, b[0]) - a[0]) / (b[0] - a[0])) / 2 for a, b in zip(knots, knots[1:], strict=False) if t > a[0])  # noqa: B023, E731
        shares = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
        got = [r.t for r in spark.createDataFrame([(x,) for x in shares], "x double").select(M.position_at(F.col("x"), knots).alias("t")).collect()]
        assert [area(t) / area(1.0) for t in got] == pytest.approx(shares, abs=1e-9)


def test_mix_is_sorted_and_names_may_clash(spark, docs_of):
    docs = docs_of([(i, "w " * (i % 9), f"s{i % 4}") for i in range(200)]).selectExpr("*", "1 AS size", "2 AS position", "3 AS target", "4 AS row", "5 AS key")
    rows = M.mix(docs).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert M.stage(spark, docs, "").columns == docs.columns and {(r.row.size, r.row.position, r.row.target, r.row.row) for r in rows} == {(1, 2, 3, 4)}


def test_edges(spark, docs_of):
    docs = docs_of([(1, None, None), (2, "", "a"), (2, "", "a"), (None, "x y", "a")])
    assert M.stage(spark, docs, "").count() >= 4
    assert M.stage(spark, docs_of([]), "").isEmpty()


def test_plan_equals_a_sequential_one(spark):
    """Documents taken one after the other along each source's target, pass after pass."""
    rng = random.Random(6)
    docs = [(i, rng.choice(["a", "b", "c", None]), rng.choice([0, 1, 7, 40, 900])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long")
    hashes = {r.doc_id: r.h % 2**64 for r in df.select("doc_id", F.xxhash64("doc_id", "size").alias("h")).collect()}
    sizes = {s: sum(d[2] for d in docs if d[1] == s) for s in "abc"} | {None: sum(d[2] for d in docs if d[1] is None)}
    targets, copies = targets_by_hand(sizes), {}
    for source, whole in sizes.items():
        first = lambda d: int((1 - d[2] / whole) * 2**51) if d[2] * M.LARGEST > whole else hashes[d[0]]  # noqa: B023, E731
        reached = 0
        for doc in sorted((d for d in docs if d[1] == source), key=lambda d: (first(d), d[0])):
            middles = [reached + whole * turn + doc[2] / 2 for turn in range(M.CAP)]
            copies[doc[0]] = sum(m <= targets[source] or (turn == 0 and doc[2] == 0) for turn, m in enumerate(middles))
            reached += doc[2]
    plan = {r.doc_id: r for r in M.plan_mix(df).collect()}
    assert {i: r.copies for i, r in plan.items()} == copies and len(set(copies.values())) > 1
    for source in sizes:
        asked = sorted(((p, r.size) for r in plan.values() if r.source == source for p in r.positions))
        assert all(0 <= p <= 1 for p, _ in asked) and sum(n for _, n in asked) == pytest.approx(targets[source], abs=900)
