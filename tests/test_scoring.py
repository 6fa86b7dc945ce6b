"""Rules, sweep and queue."""

import random

import pytest
from pyspark.sql import functions as F

from tillwatch.config import SweepCosts
from tillwatch.functions.rules import hybrid_score, linear_score
from tillwatch.plans import eda, scoring

CUTS = [i * (1.0 / 99.0) for i in range(99)] + [1.0]


def _frame(spark, scores):
    rows = [(f"m{i}", s, i % 3 == 0) for i, s in enumerate(scores)]
    frame = spark.createDataFrame(rows, "merchant_id string, final_risk_score double, bad boolean")
    return frame.withColumn("default_next_60d", F.col("bad").cast("int"))


def test_sweep_against_a_scan_per_cut(spark):
    rng = random.Random(11)
    scores = [rng.random() for _ in range(200)] + CUTS * 2 + [c - 1e-16 for c in CUTS] + [c + 1e-16 for c in CUTS]
    scores += [None, float("nan"), -0.5, 1.5, 0.0, -0.0, 0.7999999999999999]
    found = {r.threshold: r for r in scoring.threshold_sweep(_frame(spark, scores)).collect()}
    assert sorted(found) == CUTS
    labelled = [(s, i % 3 == 0) for i, s in enumerate(scores)]
    for cut in CUTS:
        hit = [(s is not None and s >= cut, bad) for s, bad in labelled]
        tp, fp = sum(a and b for a, b in hit), sum(a and not b for a, b in hit)
        fn = sum(not a and b for a, b in hit)
        row = found[cut]
        assert (row.tp, row.fp, row.fn) == (tp, fp, fn), cut
        assert row.profit == 2 * tp - fp - 10 * fn
        assert row.tp + row.fn == sum(bad for _, bad in labelled)


def test_lowest_threshold_wins_ties(spark):
    sweep = scoring.threshold_sweep(_frame(spark, [0.9, 0.1, 0.1]))
    best = scoring.optimal_threshold(sweep).first()
    rows = sweep.collect()
    top = max(r.profit for r in rows)
    assert best.profit == top
    assert best.threshold == min(r.threshold for r in rows if r.profit == top)


def test_rules_keep_their_order_of_addition(spark):
    frame = spark.createDataFrame(
        [(0.02, 1000.01, 0.09, 0.016, 101), (0.02, 1000.0, 0.09, 0.015, 100), (0.0, 0.0, 0.0, 0.0, 0),
         (None, None, None, None, None), (0.02, 2000.0, 0.09, 0.0, 101)],
        "chargeback_rate_30d double, gmv_30d double, sla_breach_rate_60d double, fraud_rate_30d double, txn_count_30d long",
    )
    found = [(r.rule_score, r.rule_reason) for r in scoring.with_rules(frame).collect()]
    assert found == [
        (1.0, "High CB & Vol | SLA Breach | High Fraud Rate | High Vol"),
        (0.3, "SLA Breach"),
        (0.0, ""),
        (0.0, ""),
        (0.4 + 0.3 + 0.1, "High CB & Vol | SLA Breach | High Vol"),
    ]


def test_hybrid_skips_missing_scores(spark):
    frame = spark.createDataFrame([(None, 0.4), (float("nan"), 0.4), (0.9, 0.4)], "a double, b double")
    assert [r[0] for r in frame.select(hybrid_score(F.col("a"), F.col("b"))).collect()] == [0.4, 0.4, 0.9]


def test_linear_score(spark):
    frame = spark.createDataFrame([(1.0, 2)], "x double, n long")
    assert frame.select(linear_score({"x": 1.0, "n": -0.5}, 0.0).alias("s")).first().s == 0.5


def test_reports_on_the_flagged_table(spark):
    rows = [("a", 1, 1, 0.9), ("a", 0, 1, 0.2), ("b", 1, 0, 0.8), ("c", 0, 0, 0.1)]
    frame = spark.createDataFrame(rows, "merchant_id string, alert_flag int, default_next_60d int, challenger_score double")
    found = scoring.alert_metrics(frame).first()
    assert (found.merchants_scored, found.alerts, found.alert_rate, found.defaults_captured, found.recall) == (3, 2, 0.5, 1, 0.5)
    cost = scoring.cost_report(frame, SweepCosts()).first()
    assert tuple(cost) == (1, 1, 1, 10, 1, -9)
    none = frame.withColumn("default_next_60d", F.lit(0))
    assert scoring.alert_metrics(none).first().recall is None


def test_score_column_fallback(spark):
    frame = spark.createDataFrame([("a", "2024-01-31", 0.1, 0.9)], "merchant_id string, month_end string, score double, risk_score double")
    assert scoring.top_by_score(frame).first().score == 0.9
    assert scoring.top_by_score(frame.drop("risk_score")).first().score == 0.1
    with pytest.raises(ValueError):
        scoring.top_by_score(frame.drop("risk_score", "score"))


def test_histogram_edges(spark):
    frame = spark.createDataFrame([(float(i), 5.0) for i in range(41)] + [(None, 5.0)], "a double, b double")
    found = eda.histograms(frame, ("a", "b"), 40).collect()
    a = {r.bin: r.n for r in found if r.feature == "a"}
    assert a == {**{i: 1 for i in range(1, 40)}, 40: 2}
    (b,) = [r for r in found if r.feature == "b" and r.n]
    assert (b.n, b.bin_start <= 5.0 <= b.bin_end) == (42, True)
    assert len(found) == 80
    holes = spark.createDataFrame([(1.0, float("nan")), (2.0, None), (float("nan"), None)], "a double, b double")
    kept = eda.histograms(holes, ("a", "b"), 4).collect()
    assert {(r.feature, r.bin): (r.n, r.bin_start) for r in kept if r.n} == {("a", 1): (1, 1.0), ("a", 4): (1, 1.75)}
    assert {r.feature for r in kept} == {"a"} and len(kept) == 4


def test_rates_and_correlations_skip_missing_values(spark):
    frame = spark.createDataFrame(
        [("a", 1.0, 0), ("a", 2.0, 1), (None, float("nan"), 1)], "industry string, x double, default_next_60d int"
    )
    assert [tuple(r) for r in eda.rate_by(frame, "industry").collect()] == [("a", 0.5)]
    assert {r.feature: r.correlation for r in eda.correlations(frame, ("x",)).collect()}["x"] == pytest.approx(1.0)
