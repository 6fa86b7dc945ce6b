"""Percentiles and ranking metrics against sorted brute force."""

import math
import random
from datetime import date

import numpy as np
import pytest

from tillwatch.operators.quantile import grouped_percentile
from tillwatch.operators.ranking import running_totals
from tillwatch.plans import metrics
from pyspark.sql import functions as F


@pytest.mark.parametrize("fraction", [0.0, 0.5, 0.95, 1.0])
def test_percentile_over_bands_and_hot_groups(spark, fraction):
    rng = random.Random(7)
    groups = {
        "hot": [rng.choice([100, 2500, 9_999]) for _ in range(3000)],
        "wide": [rng.randrange(-5_000_000, 900_000_000_000) for _ in range(500)],
        "two": [1_048_575, 1_048_576],
        "one": [42],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("one", None), ("empty", None)]
    frame = spark.createDataFrame(rows, "g string, v long")
    found = {r.g: r.p for r in grouped_percentile(frame, ["g"], "v", fraction, "p").collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        assert found[g] == pytest.approx(float(np.quantile(np.array(values, dtype=float), fraction)), rel=1e-12)


@pytest.mark.parametrize("buckets", [1, 2, 7, 256])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, buckets, descending):
    rng = random.Random(3)
    values = [rng.choice(["x", f"k{rng.randrange(60):03d}"]) for _ in range(900)]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    found = running_totals(frame, "v", {"n": F.count(F.lit(1))}, descending, buckets).collect()
    total, expected = 0, {}
    for v in sorted(set(values), reverse=descending):
        total += values.count(v)
        expected[v] = (values.count(v), total)
    assert {r.v: (r.n, r.cum_n) for r in found} == expected


def _scored(spark, seed, n=800, levels=25):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        score = 0.5 if rng.random() < 0.35 else rng.randrange(levels) / levels
        rows.append((f"m{i // 3:04d}", f"2024-{i % 3 + 10:02d}-28", score, int(rng.random() < 0.1 + score / 3)))
    frame = spark.createDataFrame(rows, "merchant_id string, month string, score double, default_next_60d int")
    return rows, frame.withColumn("month_end", F.to_date("month")).drop("month")


def _areas(rows):
    points, tp, n = [(0.0, 1.0)], 0, 0
    pos = sum(r[3] for r in rows)
    roc, fp0, tp0 = 0.0, 0, 0
    for cut in sorted({r[2] for r in rows}, reverse=True):
        tied = [r for r in rows if r[2] == cut]
        tp, n = tp + sum(r[3] for r in tied), n + len(tied)
        points.append((tp / pos, tp / n))
        roc += (n - tp - fp0) * (tp + tp0) / 2
        fp0, tp0 = n - tp, tp
    pr = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    return pr, roc / (pos * (len(rows) - pos)), points


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_areas_and_curve_with_ties(spark, seed):
    rows, frame = _scored(spark, seed)
    pr, roc, points = _areas(rows)
    found = metrics.areas(frame, "score").first()
    assert found.pr_auc == pytest.approx(pr, rel=1e-12)
    assert found.roc_auc == pytest.approx(roc, rel=1e-12)
    curve = {(r.recall, r.precision) for r in metrics.pr_curve(frame, "score").collect()}
    assert curve == set(points)


def test_first_precision_is_not_the_end_point(spark):
    """The curve starts at precision 1 even where the highest score holds negatives."""
    frame = spark.createDataFrame([(0.9, 0), (0.9, 1), (0.1, 1)], "score double, default_next_60d int")
    assert metrics.pr_auc(frame, "score").first().pr_auc == pytest.approx(0.5 * 0.75 + 0.5 * (0.5 + 2 / 3) / 2)


@pytest.mark.parametrize("share", [0.001, 0.05, 0.3, 0.5, 0.9, 1.0])
def test_precision_at_share_with_ties(spark, share):
    rows, frame = _scored(spark, 5)
    k = int(share * len(rows))
    top = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))[:k]
    found = metrics.precision_at(frame, "score", share).first()
    assert found.k == k
    if k:
        assert found.precision_at_k == pytest.approx(sum(r[3] for r in top) / k)
    else:
        assert found.precision_at_k is None


def test_precision_needs_scores(spark):
    frame = spark.createDataFrame(
        [("a", "x", None, 1), ("b", "x", 0.1, 0)], "merchant_id string, month_end string, score double, default_next_60d int"
    )
    assert tuple(metrics.precision_at(frame, "score", 1.0).first()) == (1, 0.0)
    assert tuple(metrics.precision_at(frame, "score", 0.5).first()) == (0, None)
    assert metrics.unscored(frame, {"m": "score"}).first().unscored == 1


def test_rows_without_score_are_left_out_everywhere(spark):
    rows = [("a", "x", None, 1), ("b", "x", 0.9, 1), ("c", "x", 0.1, 0), ("d", "x", 0.8, 1)]
    frame = spark.createDataFrame(rows, "merchant_id string, month_end string, score double, default_next_60d int")
    assert max(r.recall for r in metrics.pr_curve(frame, "score").collect()) == 1.0
    assert metrics.areas(frame, "score").first().asDict() == {"pr_auc": 1.0, "roc_auc": 1.0}
    assert tuple(metrics.precision_at(frame, "score", 0.7).first()) == (2, 1.0)


def test_one_class_only(spark):
    frame = spark.createDataFrame([(0.9, 0), (0.1, 0)], "score double, default_next_60d int")
    assert metrics.areas(frame, "score").first().asDict() == {"pr_auc": None, "roc_auc": None}


def test_comparison_has_one_row_per_model(spark):
    rows, frame = _scored(spark, 4)
    frame = frame.withColumn("other", -F.col("score"))
    found = {r.model: r for r in metrics.model_comparison(frame, {"a": "score", "b": "other"}).collect()}
    pr, roc, _ = _areas(rows)
    assert found["a"].pr_auc == pytest.approx(pr) and found["b"].roc_auc == pytest.approx(1 - roc)


def test_precision_at_ties_repeats_and_nan(spark):
    """Against a plain sort: NaN above all, ties by key, month and label, repeated rows cut in their middle."""
    rng = random.Random(8)
    pool = [None, float("nan"), float("inf"), 0.0, -0.0, 0.5, 0.5, 0.25]
    rows = [(rng.choice(pool), f"m{rng.randrange(6)}", date(2024, 1 + rng.randrange(2), 1), rng.choice([0, 1, None])) for _ in range(400)]
    frame = spark.createDataFrame(rows, "score double, merchant_id string, month_end date, default_next_60d int")

    def rank(row):
        return (float("-inf") if math.isnan(row[0]) else -row[0], row[1], row[2], row[3] or 0)

    ranked = sorted((r for r in rows if r[0] is not None), key=rank)
    for share in (0.003, 0.05, 0.21, 0.5, 0.77, 1.0):
        k = int(share * len(ranked))
        found = metrics.precision_at(frame, "score", share, buckets=7).first()
        assert tuple(found) == (k, sum(r[3] or 0 for r in ranked[:k]) / k if k else None)


@pytest.mark.parametrize("cells", [4, 32])
def test_thinned_curve_is_bounded_and_its_error_certified(spark, cells):
    rng = random.Random(cells)
    rows = [(round(rng.random(), 3), int(rng.random() < 0.2)) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "score double, default_next_60d int")
    whole = [(r.precision, r.recall) for r in metrics.pr_curve(frame, "score").orderBy(F.desc_nulls_first("threshold")).collect()]
    found = metrics.thinned_pr_curve(frame, "score", cells).orderBy(F.desc_nulls_first("threshold")).collect()
    thin = [(r.precision, r.recall) for r in found]
    assert len(thin) <= 4 * (cells + 1) + 1 < len(whole) and set(thin) <= set(whole)

    def area(points):
        return sum((b[1] - a[1]) * (a[0] + b[0]) / 2 for a, b in zip(points, points[1:]))

    assert abs(area(thin) - area(whole)) <= sum({r.cell: r.slack for r in found}.values()) + 1e-12
    for precision, recall in whole:
        passes = [
            abs(a[1] + (b[1] - a[1]) * ((precision - a[0]) / (b[0] - a[0]) if a[0] != b[0] else 0) - recall)
            for a, b in zip(thin, thin[1:])
            if min(a[0], b[0]) <= precision <= max(a[0], b[0])
        ]
        assert min(passes) <= 1 / cells + 1e-12


def test_thinned_curve_without_rows_or_positives(spark):
    empty = spark.createDataFrame([], "score double, default_next_60d int")
    assert [tuple(r) for r in metrics.thinned_pr_curve(empty, "score").collect()] == [(-1, None, 1.0, 0.0, 0.0)]
    none = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.3, 0)], "score double, default_next_60d int")
    found = metrics.thinned_pr_curve(none, "score").where("cell IS NULL").collect()
    assert sorted(r.threshold for r in found) == [0.1, 0.3] and all(r.recall is None for r in found)


def test_sketches_of_days_give_windows_within_their_rank_error(make, spark):
    """A hot merchant: any window is merged from its days; a merchant with few payments gets the exact rank."""
    from tillwatch.config import Spine
    from tillwatch.plans import features

    spine = Spine(date(2024, 1, 1), date(2024, 3, 1))
    hot = spark.range(60_000).selectExpr(
        "'t' || id AS txn_id", "'hot' AS merchant_id", "timestamp_ntz'2024-01-01 08:00:00' + make_dt_interval(int(id % 90)) AS txn_ts",
        "CAST(pmod(xxhash64(id), 1000000) / 100 AS decimal(12,2)) AS amount", "'CARD' AS channel", "'APPROVED' AS status",
        "0 AS is_fraud", "0 AS is_chargeback",
    )
    few = make.txns(
        *[("few", f"2024-02-{d:02d} 10:00", f"{d}.00", "APPROVED", 0, 0) for d in range(1, 22)],
        ("few", "2024-02-25 10:00", "500.00", "DECLINED", 0, 0), (None, "2024-02-25 10:00", "1.00", "APPROVED", 0, 0),
    )
    txns = hot.unionByName(few.select(*hot.columns))
    sketches = features.daily_amount_sketches(txns, spine.past(60))
    amounts = [(r.txn_ts.date(), float(r.amount)) for r in hot.collect()]
    for width in (30, 60):
        found = {(r.merchant_id, r.month_end): r.amount for r in features.sketched_percentile(sketches, spine, width).collect()}
        assert found[("few", date(2024, 2, 29))] == 20.0
        for end in (date(2024, 1, 31), date(2024, 2, 29), date(2024, 3, 31)):
            seen = [a for d, a in amounts if 0 <= (end - d).days < width]
            rank = sum(a <= found[("hot", end)] for a in seen) / len(seen)
            assert abs(rank - 0.95) < 0.011
        assert {m for m, _ in found} == {"hot", "few"}
