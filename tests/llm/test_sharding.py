import random
import zlib

from pyspark.sql import functions as F

from accordant.llm import sharding


def shards(spark, rows, n):
    docs = spark.createDataFrame(rows, "doc_id long, size long, shard_hint string")
    return docs, sharding.byte_shards(docs, "doc_id", "size", n).collect()


def check(rows, got, n):
    assert sorted(map(str, ((r.doc_id, r.size, r.shard_hint) for r in got))) == sorted(map(str, rows))
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    total, most = sum(r.size for r in got), max((r.size for r in got), default=0)
    ends = None
    for s in sorted(by):
        own = sorted(by[s], key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        keys = [(r.doc_id is not None, r.doc_id or 0) for r in own]
        assert keys == sorted(keys) and (ends is None or ends <= keys[0])
        ends = keys[-1]
        assert 0 <= s < n and abs(sum(r.size for r in own) - total / n) <= most


def test_contiguous_balanced_and_gapless(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([16, 20, 300, 5000]), "x") for i in rng.sample(range(10_000), 400)]
    for n in (1, 7, 40):
        check(rows, shards(spark, rows, n)[1], n)


def test_hard_rows(spark):
    rows = [(5, 16, None)] * 120 + [(None, 16, "a"), (None, 40, "b"), (1, 0, "z"), (9, 10**9, "huge"), (-3, 17, "n")]
    check(rows, shards(spark, rows, 8)[1], 8)
    assert shards(spark, [], 4)[1] == []
    assert [(r.shard, r.slot) for r in shards(spark, [(1, 0, "x")], 4)[1]] == [(0, 0)]


def test_query(spark, tmp_path):
    docs = spark.createDataFrame([(1, "héllo", "c"), (2, None, "c"), (3, "", "c")], "doc_id long, text string, size string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in sharding.op9_query(spark, str(tmp_path)).collect()}
    assert (got[1].size, got[1].text_crc32) == (len("héllo".encode()) + 16, zlib.crc32("héllo".encode())) and (got[2].size, got[2].text_crc32) == (16, 0)
    assert all(r.law == "bytes" and r.grown_shard is None for r in got.values())
    assert F is not None
