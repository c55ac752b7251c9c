import zlib
from collections import Counter

import numpy as np

from stackroom.llm import sharding


def jump_by_hand(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(1).integers(0, 2**63, 500, dtype=np.uint64)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, n).tolist() == [jump_by_hand(int(k), n) for k in keys]
    assert len(sharding.jump(np.zeros(0, np.uint64), 8)) == 0


def test_growth_moves_rows_only_into_the_new_shard(spark):
    df = sharding.add_shards(sharding.add_shards(spark.range(5000), "id", 8), "id", 9, "grown").collect()
    moved = [r for r in df if r.shard != r.grown]
    assert {r.grown for r in moved} == {8} and 5000 / 9 * 0.7 < len(moved) < 5000 / 9 * 1.3


def test_query(spark, small):
    rows = sharding.op3_sharding(spark, small).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert Counter(r.doc_id for r in rows) == Counter(texts.keys())
    for shard in range(8):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "key" and r.grown_shard in (r.shard, 8)


def test_edges(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), (7, 3), (7, 3)], "key long, shard long")
    rows = sharding.add_slots(sharding.add_shards(df, "key", 2), "key", []).collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.key == 7}) == 1 and len({r.shard for r in rows if r.key is None}) == 1
    assert sharding.add_slots(sharding.add_shards(df.where("false"), "key"), "key", []).isEmpty()
