"""Window membership, day by day, against plain arithmetic."""

from datetime import date, datetime, timedelta
from calendar import monthrange

import pytest
from pyspark.sql import functions as F

from tillwatch.config import Spine
from tillwatch.operators.rollup import daily_activity
from tillwatch.operators.spine import month_spine, month_spine_ends
from tillwatch.operators.windows import (
    at_anchors, future_months, future_totals, month_members, past_members, past_months, past_totals,
)
from tillwatch.plans import features, labels

SPINE = Spine(date(2024, 1, 1), date(2024, 4, 1))
ENDS = [date(2024, m, monthrange(2024, m)[1]) for m in (1, 2, 3, 4)]


def _days(first, last):
    return [first + timedelta(days=i) for i in range((last - first).days + 1)]


def test_spine_has_leap_february_and_every_month(make):
    rows = month_spine(make.merchants("a", "b"), SPINE).collect()
    assert sorted({r.month_end for r in rows}) == ENDS
    assert len(rows) == 8
    assert month_spine_ends(make.merchants("a", "b").union(make.merchants("a")), SPINE).count() == 8


@pytest.mark.parametrize("width", [1, 30, 31, 60, 90])
def test_past_members_every_day(spark, width):
    days = _days(date(2023, 9, 1), date(2024, 6, 30))
    rows = spark.createDataFrame([(d,) for d in days], "day date")
    found = {(r.day, r.month_end) for r in past_members(rows, width, SPINE).collect()}
    assert found == {(d, e) for d in days for e in ENDS if e - timedelta(days=width) < d <= e}


@pytest.mark.parametrize("width", [1, 30, 60])
@pytest.mark.parametrize("clock", ["date", "ts"])
def test_future_sums_every_half_day(make, width, clock):
    stamps = [datetime(2023, 12, 20) + timedelta(hours=12 * i) for i in range(2 * 240)]
    txns = make.txns(*[("a", f"{t:%Y-%m-%d %H:%M}", "1.00", "APPROVED", 1, 0) for t in stamps])
    daily = daily_activity(txns, clock=clock)
    members = month_members(
        daily, make.merchants("a"), future_months(F.col("day"), width, SPINE), SPINE.ahead(width), SPINE
    )
    found = {r.month_end: r.next_fraud for r in at_anchors(members, future_totals(("fraud",), width)).collect()}
    for end in ENDS:
        midnight = datetime(end.year, end.month, end.day)
        if clock == "date":
            inside = [t for t in stamps if 0 < (t.date() - end).days <= width]
        else:
            inside = [t for t in stamps if midnight < t <= midnight + timedelta(days=width)]
        assert found[end] == len(inside), (end, clock)


@pytest.mark.parametrize("clock", ["date", "ts"])
def test_past_sums_every_half_day(make, clock):
    stamps = [datetime(2023, 9, 1) + timedelta(hours=12 * i) for i in range(2 * 250)]
    txns = make.txns(*[("a", f"{t:%Y-%m-%d %H:%M}", "1.00", "APPROVED", 1, 0) for t in stamps])
    daily = daily_activity(txns, clock=clock)
    members = month_members(
        daily, make.merchants("a"), past_months(F.col("day"), 60, SPINE), SPINE.past(60), SPINE
    )
    found = {r.month_end: r.fraud for r in at_anchors(members, past_totals(("fraud",), 60)).collect()}
    for end in ENDS:
        midnight = datetime(end.year, end.month, end.day)
        if clock == "date":
            inside = [t for t in stamps if 0 <= (end - t.date()).days < 60]
        else:
            inside = [t for t in stamps if midnight - timedelta(days=60) < t <= midnight]
        assert found[end] == len(inside)


def test_empty_windows(make):
    """No events at all: the row count of the outer join is 1, everything else 0."""
    none = make.txns(("other", "2024-02-10 10:00", "5.00", "APPROVED", 0, 0))
    row = features.txn_features_30d(none, make.merchants("a"), SPINE).first().asDict()
    assert row.pop("txn_count_30d") == 1
    assert {v for k, v in row.items() if k not in ("merchant_id", "month_end")} == {0}
    events = make.sla(("other", "2024-02-10 10:00", 1))
    table = features.merchant_month_features(none, events, make.merchants("a"), SPINE)
    assert table.count() == 4
    rates = labels.forward_rates(none, events, make.merchants("a"), SPINE).collect()
    assert len(rates) == 4 and all(r.future_txn_count == 0 for r in rates)


def test_history_before_the_spine_counts_in_the_first_month(make):
    txns = make.txns(
        ("a", "2020-05-05 10:00", "1.00", "APPROVED", 1, 0),
        ("a", "2024-02-29 23:59", "1.00", "APPROVED", 0, 0),
        ("a", "2024-05-01 00:00", "1.00", "APPROVED", 1, 0),
    )
    found = {
        r.month_end: (r.historical_fraud_rate, r.historical_fraud_stddev)
        for r in features.historical_fraud(txns, make.merchants("a"), SPINE).collect()
    }
    assert found[ENDS[0]] == (1.0, 0.0)
    assert found[ENDS[1]][0] == 0.5 and abs(found[ENDS[1]][1] - 0.5**0.5) < 1e-12
    assert found[ENDS[3]] == found[ENDS[1]]


def test_null_merchants_and_null_flags(make, spark):
    txns = make.txns(
        ("a", "2024-01-20 10:00", "10.00", "APPROVED", None, 0),
        ("a", "2024-01-21 10:00", "30.00", None, 1, 0),
        (None, "2024-01-21 10:00", "30.00", "APPROVED", 1, 0),
    )
    row = features.txn_features_30d(txns, make.merchants("a"), SPINE).where("month_end = '2024-01-31'").first()
    assert (row.txn_count_30d, row.fraud_rate_30d, row.decline_rate_30d, row.gmv_30d) == (2, 1.0, 0.0, 10.0)


def test_decline_spike_of_dates_cut_by_a_window(make):
    """A date counts with the part of it that the window holds: midnight alone at one edge, the rest alone at the other."""
    import random

    from tillwatch.operators.windows import transaction_windows

    rng, rows = random.Random(4), []
    for day in range(130):
        for clock_time in ("00:00", "00:00", "00:00", "09:00", "21:30"):
            if rng.random() < 0.7:
                stamp = datetime(2023, 11, 20) + timedelta(days=day)
                rows.append((stamp.replace(hour=int(clock_time[:2]), minute=int(clock_time[3:])), rng.random() < 0.4))
    txns = make.txns(*[("a", f"{t:%Y-%m-%d %H:%M}", "1.00", "DECLINED" if d else "APPROVED", 0, 0) for t, d in rows])
    daily = daily_activity(txns, clock="ts")
    months = past_months(F.col("day"), 90, SPINE)
    members = month_members(daily, make.merchants("a"), months, SPINE.past(90), SPINE, halves=True)
    found = {r.month_end: (r.spike_1, r.spike_30, r.spike_90) for r in transaction_windows(members, (1, 30, 90), split_days=True).collect()}
    for end in ENDS:
        midnight, spikes = datetime(end.year, end.month, end.day), []
        for width in (1, 30, 90):
            by_date = {}
            for t, declined in rows:
                if midnight - timedelta(days=width) < t <= midnight:
                    by_date.setdefault(t.date(), []).append(declined)
            shares = [sum(x) / len(x) for x in by_date.values() if len(x) >= 3]
            spikes.append(max(shares) if shares else None)
        assert found[end] == pytest.approx(tuple(spikes))


def test_deviation_of_large_amounts_loses_no_digits(make):
    """Amounts of ten digits that differ by cents, some squares beyond a long: as exact arithmetic has it."""
    import statistics
    from decimal import Decimal

    amounts = [Decimal(9_999_999_000) + Decimal(d) / 100 for d in range(25)] + [Decimal("20000000.01"), Decimal("30000000.01")]
    for chosen in (amounts[:25], amounts):
        txns = make.txns(*[("a", f"2024-01-{1 + i:02d} 10:00", str(x), "APPROVED", 0, 0) for i, x in enumerate(chosen)])
        row = features.txn_features_90d(txns, make.merchants("a"), SPINE, as_written=False).where("month_end = '2024-01-31'").first()
        assert row.rolling_3m_volatility_90d == pytest.approx(float(statistics.stdev(chosen)), rel=1e-12)


def test_scan_tasks_hold_no_totals(spark, make):
    """Raw rows are spread as they are: totals are made behind the shuffle, in partitions that are not merged, so no
    task's memory grows with the rows of a scan or with what merged partitions hold."""
    from tillwatch.operators.rollup import daily_activity
    from tillwatch.plans import features
    from tillwatch.sources import stand_in as fx

    table = fx.StandIn(spark, "/root/testdata/sf0.001")
    plan = daily_activity(table.transactions, table.sla_events)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    assert sum("Exchange" in line for line in lines) == 1
    exchange = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert "REPARTITION_BY_NUM" in lines[exchange]
    assert not any("HashAggregate" in line for line in lines[exchange:])
    windows = features.txn_features_60d(table.transactions, table.merchants, fx.SPINE)
    text = windows._jdf.queryExecution().executedPlan().toString()
    assert text.count("REPARTITION_BY_NUM") == 2 and "REPARTITION_BY_COL" not in text
