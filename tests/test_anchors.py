"""Known totals of the stand-in tables for the reporting year 2000."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tillwatch.config import Spine
from tillwatch.plans import features, labels, quality
from tillwatch.sources import stand_in as fx

YEAR = Spine(date(2000, 1, 1), date(2000, 12, 1))


@pytest.fixture(scope="module")
def table(spark):
    return fx.StandIn(spark, "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def wide(table):
    return features.merchant_month_features(table.transactions, table.sla_events, table.merchants, YEAR).cache()


def test_rows_and_rates(table):
    assert table.merchants.count() == 100
    row = table.transactions.agg(
        F.count(F.lit(1)), F.avg("is_fraud"), F.avg("is_chargeback"), F.avg((F.col("status") == "DECLINED").cast("int"))
    ).first()
    assert row[0] == 60_000
    assert [round(x, 4) for x in row[1:]] == [0.0276, 0.0226, 0.1673]
    assert table.sla_events.count() == 15_000


def test_features(wide):
    row = wide.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("active_days_30d") == 0).alias("idle"),
        F.count_if(F.col("rolling_max_decline_spike") > 0).alias("spikes"),
        F.avg((F.col("txn_count_30d") > 9).cast("int")).alias("busy"),
        F.avg((F.col("chargeback_rate_30d") > 0.01).cast("int")).alias("backs"),
        F.avg((F.col("fraud_rate_30d") > 0.015).cast("int")).alias("frauds"),
    ).first()
    assert (row.n, row.idle, row.spikes) == (1200, 1, 85)
    assert [round(x, 3) for x in (row.busy, row.backs, row.frauds)] == [0.182, 0.169, 0.182]


def test_labels_by_month(table):
    rates = labels.forward_rates(table.transactions, table.sla_events, table.merchants, YEAR)
    found = (
        labels.default_label(rates, fx.LABEL_RULE)
        .groupBy(F.month("month_end").alias("m"))
        .agg(F.sum("default_next_60d").alias("n"))
        .orderBy("m")
        .collect()
    )
    assert [r.n for r in found] == [5, 3, 6, 5, 4, 5, 6, 3, 3, 5, 3, 4]


def test_grid_cells(table):
    rates = labels.forward_rates(table.transactions, table.sla_events, table.merchants, YEAR, as_written=False)
    cells = labels.threshold_grid(rates, fx.GRID_CHARGEBACK, fx.GRID_FRAUD).collect()
    assert {(r.chargeback_threshold, r.fraud_threshold): round(100 * r.default_rate, 2) for r in cells} == {
        (0.12, 0.25): 3.50, (0.15, 0.15): 3.33, (0.15, 0.18): 2.67, (0.15, 0.20): 2.25,
        (0.18, 0.15): 2.50, (0.20, 0.15): 2.42,
    }
    assert labels.threshold_grid(rates, fx.GRID_CHARGEBACK, fx.GRID_FRAUD, keep=None).count() == 25


def test_exceptions(table, wide):
    found = quality.exception_summary(
        quality.data_exceptions(table.transactions, table.merchants_sparse, wide, fx.AS_OF)
    )
    assert {r.exception_type: r.exceptions for r in found.collect()} == {
        "ORPHAN_TXN": 6088, "FUTURE_TS": 3692, "DUP_TXN_ID": 11785, "LEAKAGE_GUARD": 135522,
    }
