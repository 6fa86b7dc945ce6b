import numpy as np
from pyspark.sql import functions as F

import brute
from tillwatch.llm.fuse_dedup import BinaryFuse, exact_dedup

COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def _batch(n):
    return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(n)), F.lit(0))


def _found(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 257, 5000, 70_000):
        keys = rng.integers(0, 2**64, n, dtype=np.uint64)
        fuse = BinaryFuse.build(np.concatenate([keys, keys[: n // 2]]))
        assert fuse.contains(keys).all()
        assert fuse.contains(rng.integers(0, 2**64, 100_000, dtype=np.uint64)).mean() < 2e-4
        assert len(fuse.prints) < 1.3 * n + 400


def test_matches_brute_force(documents, rows):
    for n in (1, 2, 3):
        assert _found(exact_dedup(documents, _batch(n), bucket=20)) == sorted(brute.exact_groups(rows), key=repr)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert _found(exact_dedup(odd, _batch(2))) == sorted(brute.exact_groups(rows), key=repr)
    assert exact_dedup(none, _batch(2)).count() == 0


def test_null_ids_come_last(spark):
    rows = [(None, "a b"), (7, "ab"), (3, "ab"), (None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _found(exact_dedup(df, _batch(2))) == sorted(brute.exact_groups(rows), key=repr)
