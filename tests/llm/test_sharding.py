"""Shards: near equal bytes, whole rows, gapless slots, and the tree's own order."""

import zlib
from collections import Counter, defaultdict

from boardwalk.llm import sharding

SF = "/root/testdata/sf0.1"


def held(rows, key="doc_id"):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
        keys = [r[key] if r[key] is not None else -1 for r in sorted(part, key=lambda r: r.slot)]
        assert keys == sorted(keys)
    return {s: sum(r.size for r in part) for s, part in by.items()}


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = sharding.op6_kd_shards(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(docs.keys())
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    size = held(got)
    mean = sum(size.values()) / 40
    assert sorted(size) == list(range(40)) and max(abs(n - mean) for n in size.values()) < 0.06 * mean


SCHEMA = "doc_id long, text string, source string, lang string, node int, size string"


def test_nulls_ties_and_repeats(spark):
    rows = [(i % 50 if i % 9 else None, None if i % 11 == 0 else "x" * (i % 80), None if i % 3 else "a", "en", 1, "y") for i in range(1200)]
    df = spark.createDataFrame(rows + rows[:100], SCHEMA)
    got = sharding.shard(df, target_bytes=4000).collect()
    assert len(got) == 1300
    size = held(got)
    assert len(size) == -(-sum(size.values()) // 4000) and max(size.values()) < 4000 * 1.1
    again = sharding.shard(df.repartition(5), target_bytes=4000).collect()
    plain = lambda rows: sorted((str(r.doc_id), r.size, r.shard) for r in rows)
    assert plain(again) == plain(got)


def test_hot_value_is_divided_and_empty(spark):
    df = spark.createDataFrame([(7, "same text", "s", "en", 1, "y")] * 400, SCHEMA)
    assert max(held(sharding.shard(df, shards=8).collect()).values()) <= 51 * 25
    assert sharding.shard(df.where("false"), shards=8).count() == 0
    assert {r.shard for r in sharding.shard(df.limit(1), shards=3).collect()} <= {0, 1, 2}
