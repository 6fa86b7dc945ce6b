import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillwatch.llm import rendezvous as rv


def got(df):
    return df.orderBy("shard", "slot").collect()


def test_columns_slots_and_growth(spark, documents, rows):
    found, text = got(rv.shards(documents, bucket=7)), dict(rows)
    assert len(found) == len(rows)
    for r in found:
        raw = text[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
    for shard in range(8):
        slots = [r.slot for r in found if r.shard == shard]
        assert slots == list(range(len(slots))) and slots
    assert [tuple(r) for r in found] == [tuple(r) for r in got(rv.shards(documents.repartition(9), bucket=1000))]
    moved = sum(r.grown_shard == 8 for r in found) / len(found)
    assert 0.03 < moved < 0.25


def test_key_alone_decides(spark, documents):
    other = documents.select("doc_id", F.lit("x").alias("text"))
    assert {r.doc_id: r.shard for r in rv.shards(other).collect()} == {r.doc_id: r.shard for r in rv.shards(documents).collect()}


def test_weights(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    before = {r.doc_id: r.shard for r in rv.placed(keys, (1, 2, 4, 0, 1)).collect()}
    share = {s: n / 20_000 for s, n in Counter(before.values()).items()}
    assert share.keys() == {0, 1, 2, 4}
    assert all(abs(share[s] - w / 8) < 0.02 for s, w in {0: 1, 1: 2, 2: 4, 4: 1}.items())
    more = {r.doc_id: r.shard for r in rv.placed(keys, (1, 2, 4, 0, 3)).collect()}
    assert all(more[k] in (s, 4) for k, s in before.items())
    less = {r.doc_id: r.shard for r in rv.placed(keys, (1, 2, 4, 0, 0)).collect()}
    assert all(less[k] == s for k, s in before.items() if s != 4)
    with pytest.raises(ValueError):
        rv.shard_of(F.col("doc_id"), (0, 0))
    with pytest.raises(ValueError):
        rv.shard_of(F.col("doc_id"), (1, -1))


def test_nulls_repeats_and_empty_tables(spark, odd, none):
    data = [(None, None, 1)] * 25 + [(None, "a", 1)] * 3 + [(1, "", 1), (1, None, 1), (2, "é", 1)]
    found = got(rv.shards(spark.createDataFrame(data, "doc_id long, text string, slot int"), bucket=4))
    assert len(found) == len(data) and len({r.shard for r in found if r.doc_id is None}) == 1
    for shard in {r.shard for r in found}:
        slots = [r.slot for r in found if r.shard == shard]
        assert slots == list(range(len(slots)))
    assert [(r["size"], r.text_crc32) for r in found if r.doc_id == 1] == [(1, 0), (1, 0)]
    assert [r["size"] for r in found if r.doc_id == 2] == [3]
    assert rv.shards(odd).count() == odd.count() and rv.shards(none).count() == 0


def test_long_text(spark):
    text = "lang " * 1_200_000
    r = rv.shards(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["size"], r.text_crc32, r.slot) == (len(text) + 1, zlib.crc32(text.encode()), 0)


def test_repeated_row_is_spread_in_runs(spark):
    df = spark.range(25_001).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    found = rv.shards(df)
    assert found.agg(F.min("slot"), F.max("slot"), F.countDistinct("slot")).first() == (0, 25_000, 25_001)
