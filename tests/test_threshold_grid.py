"""The threshold grid against a mean for every pair."""

import numpy as np
from pyspark.sql import functions as F

from tillwatch.config import LabelRule
from tillwatch.plans import labels

SCHEMA = "future_chargeback_rate double, future_fraud_rate double, future_decline_rate double, future_fraud_count long"


def plain(rows, c, f, rule):
    """SQL's three-valued OR of the three clauses, averaged where it is known."""
    hits = []
    for cb, fr, dec, n in rows:
        clauses = [None if cb is None else cb >= c, None if fr is None else fr >= f]
        both = [None if dec is None else dec >= rule.decline, None if n is None else n >= rule.fraud_count]
        clauses.append(False if False in both else None if None in both else True)
        hit = True if True in clauses else None if None in clauses else False
        if hit is not None:
            hits.append(hit)
    return sum(hits) / len(hits) if hits else None


def test_hundred_by_hundred_pairs(spark):
    rng, rule = np.random.default_rng(2), LabelRule()
    rows = [tuple(None if rng.random() < 0.1 else float(x) for x in rng.random(3) / 3) + (None if rng.random() < 0.1 else int(rng.integers(0, 20)),)
            for _ in range(400)]
    cuts = [i / 300 for i in range(100)]
    rows[0] = (cuts[7], cuts[9], 0.0, 0)  # rates that are thresholds
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    grid = labels.threshold_grid(frame, tuple(cuts), tuple(cuts), keep=None)
    found = {(r.chargeback_threshold, r.fraud_threshold): r.default_rate for r in grid.collect()}
    assert len(found) == 10_000
    for a in range(0, 100, 7):
        for b in range(0, 100, 9):
            assert found[cuts[a], cuts[b]] == plain(rows, cuts[a], cuts[b], rule), (a, b)
    few = {(r.chargeback_threshold, r.fraud_threshold): r.default_rate for r in labels.threshold_grid(frame, (cuts[50], cuts[3]), (cuts[8],), None).collect()}
    assert few == {(cuts[a], cuts[8]): found[cuts[a], cuts[8]] for a in (3, 50)}


def test_width_of_the_plan_does_not_grow_with_pairs(spark):
    frame = spark.createDataFrame([(0.1, 0.1, 0.1, 1)], SCHEMA)
    cuts = tuple(i / 100 for i in range(100))
    plan = labels.threshold_grid(frame, cuts, cuts, None)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("count_if") + plan.count("count(if") <= 8 and "cell_" not in plan


def test_no_rows(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert [r.default_rate for r in labels.threshold_grid(frame, (0.1,), (0.2,), None).collect()] == [None]
    assert labels.threshold_grid(frame, (0.1,), (0.2,)).count() == 0
