"""Merchant-month features over past windows; nothing dated after the month end enters a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.config import KEY, LABEL, MONTH, Days, LabelRule, Spine
from tillwatch.functions.columns import (
    flag_stddev,
    from_cents,
    guarded_z,
    interact,
    or_zero_double,
    ratio,
    sample_stddev,
    to_cents,
    window_day,
)
from tillwatch.operators.deltas import mom_delta
from tillwatch.operators.quantile import grouped_percentile
from tillwatch.operators.rollup import daily_activity, events_between
from tillwatch.operators.windows import (
    all_months,
    at_anchors,
    future_totals,
    month_members,
    past_members,
    past_months,
    past_totals,
    transaction_windows,
)
from tillwatch.plans.labels import SUMS, default_label, rate_columns

ON = [KEY, MONTH]


def _rate(part: str, whole: str) -> Column:
    return or_zero_double(ratio(F.col(part), F.col(whole)))


def _money(cents: Column) -> Column:
    return or_zero_double(from_cents(cents))


def _count(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast("bigint")


def approved_p95(txns: DataFrame, spine: Spine, width: int = 30, fraction: float = 0.95) -> DataFrame:
    """Exact 95th percentile of approved amounts (in cents) per merchant and month end."""
    approved = events_between(txns, "txn_ts", spine.past(width)).where(F.col("status") == "APPROVED").select(
        KEY, window_day(F.col("txn_ts"), "date").alias("day"), to_cents(F.col("amount")).alias("cents")
    )
    return grouped_percentile(past_members(approved, width, spine), ON, "cents", fraction, "p95")


#: size of the sketches: ranks are off by about half a percent of the payments in a window
SKETCH = 800


def daily_amount_sketches(txns: DataFrame, days: Days = (None, None), k: int = SKETCH) -> DataFrame:
    """``(merchant_id, day, sketch)``: a mergeable quantile sketch of each day's approved amounts (in cents).

    Built map-side, so a hot merchant's day is one sketch of a task and day. Kept beside the day rollup, it answers for
    the percentile of any window without another pass over the payments.
    """
    approved = events_between(txns, "txn_ts", days).where((F.col("status") == "APPROVED") & F.col("amount").isNotNull())
    daily = approved.groupBy(KEY, window_day(F.col("txn_ts"), "date").alias("day"))
    return daily.agg(F.kll_sketch_agg_bigint(to_cents(F.col("amount")), F.lit(k)).alias("sketch"))


def sketched_percentile(
    sketches: DataFrame, spine: Spine, width: int = 30, fraction: float = 0.95, k: int = SKETCH
) -> DataFrame:
    """``(merchant_id, month_end, amount)``: an approved amount at about the rank ``fraction``, from the day sketches.

    Not interpolated: a real amount, whose rank is off by about ``2.3 / k^0.9`` (99 of 100 times), and exactly the
    smallest one with at least that share of the window at or below it while a sketch still holds every amount, which
    it does up to about ``k`` of them. Months without an approved payment have no row.
    """
    merged = past_members(sketches, width, spine).groupBy(*ON).agg(F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"))
    return merged.select(*ON, from_cents(F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(fraction)))).alias("amount"))


def _columns_30d(percentile: bool) -> list[Column]:
    n, m2 = F.col("n_approved_30"), F.col("dev_approved_30")
    return [
        # an empty window still counts 1: the row count of an outer join
        F.greatest(F.col("n_txn_30"), F.lit(1)).cast("bigint").alias("txn_count_30d"),
        _money(F.col("approved_30")).alias("gmv_30d"),
        or_zero_double(ratio(F.col("approved_30"), n) / 100).alias("avg_amount_30d"),
        *([_money(F.col("p95")).alias("p95_amount_30d")] if percentile else []),
        _money(sample_stddev(m2, n)).alias("amount_stddev_30d"),
        _rate("declined_30", "n_status_30").alias("decline_rate_30d"),
        _rate("fraud_30", "n_fraud_30").alias("fraud_rate_30d"),
        _rate("chargeback_30", "n_chargeback_30").alias("chargeback_rate_30d"),
        _rate("ach_30", "n_channel_30").alias("ach_share_30d"),
        _count("days_30").alias("active_days_30d"),
    ]


def _columns_60d() -> list[Column]:
    return [
        _rate("fraud_60", "n_fraud_60").alias("fraud_rate_60d"),
        _rate("chargeback_60", "n_chargeback_60").alias("chargeback_rate_60d"),
    ]


def _columns_sla(suffix: str = "_60") -> list[Column]:
    return [
        _count(f"n_event{suffix}").alias("sla_events_60d"),
        _count(f"breached{suffix}").alias("sla_breaches_60d"),
        _rate(f"breached{suffix}", f"n_breached{suffix}").alias("sla_breach_rate_60d"),
    ]


def _columns_90d(as_written: bool, approved_only: bool, volatility: str) -> list[Column]:
    """``as_written`` keeps the original's product of payments and active days: every payment counts once per
    active day, which inflates the fraud sum and shrinks the deviation, and leaves means and maxima alone."""
    days = F.col("days_90")
    amounts = "approved" if approved_only else "cents"
    n, m2 = F.col(f"n_{amounts}_90"), F.col(f"dev_{amounts}_90")
    fraud = F.col("fraud_90") * days if as_written else F.col("fraud_90")
    return [
        F.coalesce(fraud, F.lit(0)).cast("bigint").alias("cumulative_fraud_90d"),
        _money(sample_stddev(m2, n, days if as_written else None)).alias(volatility),
        _rate("declined_90", "n_status_90").alias("decline_rate_90d"),
        or_zero_double(F.col("spike_90")).alias("rolling_max_decline_spike"),
    ]


def _past(
    daily: DataFrame, merchants: DataFrame, width: int, spine: Spine, history: bool = False, **options
) -> DataFrame:
    months = past_months(F.col("day"), width, spine, history)
    days = spine.history() if history else spine.past(width)
    return month_members(daily, merchants, months, days, spine, **options)


def _percentile(txns: DataFrame, spine: Spine, wanted: bool) -> tuple[dict, tuple[Column, ...]]:
    """What the windows need for the percentile: rows beside the day rows, and an aggregate; nothing if not wanted."""
    return ({"at_month": approved_p95(txns, spine)}, (F.max("p95").alias("p95"),)) if wanted else ({}, ())


def txn_features_30d(
    txns: DataFrame, merchants: DataFrame, spine: Spine = Spine(), percentile: bool = True
) -> DataFrame:
    """Without ``percentile``, all but that column, and none of its work: a second pass over the payments."""
    daily = daily_activity(txns, txn_days=spine.past(30))
    rows, extra = _percentile(txns, spine, percentile)
    windows = transaction_windows(_past(daily, merchants, 30, spine, **rows), (30,), extra=extra)
    return windows.select(*ON, *_columns_30d(percentile))


def sla_features_60d(sla: DataFrame, merchants: DataFrame, spine: Spine = Spine()) -> DataFrame:
    daily = daily_activity(sla=sla, sla_days=spine.past(60))
    totals = past_totals(("n_event", "breached", "n_breached"), 60)
    return at_anchors(_past(daily, merchants, 60, spine), totals).select(*ON, *_columns_sla(""))


def txn_features_60d(txns: DataFrame, merchants: DataFrame, spine: Spine = Spine()) -> DataFrame:
    daily = daily_activity(txns, txn_days=spine.past(60))
    return transaction_windows(_past(daily, merchants, 60, spine), (60,)).select(*ON, *_columns_60d())


def txn_features_90d(
    txns: DataFrame,
    merchants: DataFrame,
    spine: Spine = Spine(),
    as_written: bool = True,
    approved_only: bool = True,
) -> DataFrame:
    """``as_written=False`` counts every payment once; ``approved_only=False`` takes the deviation of all amounts."""
    daily = daily_activity(txns, txn_days=spine.past(90))
    windows = transaction_windows(_past(daily, merchants, 90, spine), (90,))
    return windows.select(*ON, *_columns_90d(as_written, approved_only, "rolling_3m_volatility_90d"))


def _with_history(frame: DataFrame) -> DataFrame:
    """Running fraud mean and deviation over the months of each merchant."""
    to_date = Window.partitionBy(KEY).orderBy(MONTH).rowsBetween(Window.unboundedPreceding, 0)
    hits, n = F.sum("new_fraud").over(to_date), F.sum("new_n_fraud").over(to_date)
    return frame.withColumns(
        {
            "historical_fraud_rate": or_zero_double(ratio(hits, n)),
            "historical_fraud_stddev": or_zero_double(flag_stddev(hits, n)),
        }
    )


def historical_fraud(txns: DataFrame, merchants: DataFrame, spine: Spine = Spine()) -> DataFrame:
    """All-time mean and sample deviation of the fraud flag up to each month end."""
    daily = daily_activity(txns, txn_days=spine.history())
    frame = transaction_windows(_past(daily, merchants, 1, spine, history=True), (1,))
    return _with_history(frame).select(*ON, "historical_fraud_rate", "historical_fraud_stddev")


MOM_SQL = {
    "gmv_mom_change": "gmv_30d",
    "fraud_rate_mom_change": "fraud_rate_30d",
    "chargeback_rate_mom_change": "chargeback_rate_30d",
    "decline_rate_mom_change": "decline_rate_30d",
}


def mom_trends(features_30d: DataFrame, snap: bool = False) -> DataFrame:
    """Changes against the month before, as found by calendar arithmetic."""
    return mom_delta(features_30d, MOM_SQL, snap=snap).select(*ON, *MOM_SQL)


FEATURE_COLUMNS = (
    "txn_count_30d", "gmv_30d", "avg_amount_30d", "p95_amount_30d", "amount_stddev_30d", "decline_rate_30d",
    "fraud_rate_30d", "chargeback_rate_30d", "ach_share_30d", "active_days_30d", "gmv_mom_change",
    "fraud_rate_mom_change", "chargeback_rate_mom_change", "decline_rate_mom_change", "sla_events_60d",
    "sla_breaches_60d", "sla_breach_rate_60d", "fraud_rate_60d", "chargeback_rate_60d", "cumulative_fraud_90d",
    "amount_volatility_90d", "rolling_max_decline_spike", "decline_rate_90d", "fraud_acceleration",
    "chargeback_acceleration", "z_score_fraud", "risk_interaction", "decline_x_fraud",
)


def merchant_month_features(
    txns: DataFrame,
    sla: DataFrame,
    merchants: DataFrame,
    spine: Spine = Spine(),
    as_written: bool = True,
    snap: bool = False,
    daily: DataFrame | None = None,
    percentile: bool = True,
    label: LabelRule | None = None,
    ahead: int = 60,
) -> DataFrame:
    """The wide feature table: keys, industry, state and 28 features per merchant and month.

    All windows of both event tables come from one day rollup and one grouped aggregation; only the percentile needs
    a second pass over the payments. Trends and history are windows over each merchant's months, on the partitioning
    that the aggregation left. ``daily`` is a finished rollup of both event tables, to be used for the windows instead
    of the events. Without ``percentile`` the table lacks that column and the second pass is not made: the optimizer
    can't drop it from a union, so a caller that doesn't read it says so.

    With ``label`` the default label of the ``ahead`` days after the month end comes along, from the same aggregation:
    the model dataset without a second one and without a join.
    """
    days, months = spine.history(), past_months(F.col("day"), 90, spine, history=True)
    sla_days = spine.past(60)
    if label is not None:
        days, months = spine.history(ahead), all_months(F.col("day"), 90, ahead, spine)
        sla_days = (sla_days[0], days[1])
    if daily is None:
        daily = daily_activity(txns, sla, txn_days=days, sla_days=sla_days)
    rows, extra = _percentile(txns, spine, percentile)
    members = month_members(daily, merchants, months, days, spine, **rows)
    outlook = [] if label is None else rate_columns(as_written)
    if label is not None:
        extra = (*extra, *future_totals(SUMS, ahead))
    frame = transaction_windows(members, (30, 60, 90), extra=extra).select(
        *ON,
        *_columns_30d(percentile),
        *_columns_60d(),
        *_columns_sla(),
        *_columns_90d(as_written, True, "amount_volatility_90d"),
        "new_fraud",
        "new_n_fraud",
        *outlook,
    )
    if label is not None:
        frame = default_label(frame, label).drop(*(c for c in frame.columns if c.startswith("future_")))
    frame = _with_history(mom_delta(frame, MOM_SQL, snap=snap))
    return frame.join(merchants.select(KEY, "industry", "state"), KEY).withColumns(
        {
            "fraud_acceleration": F.col("fraud_rate_mom_change"),
            "chargeback_acceleration": F.col("chargeback_rate_mom_change"),
            "z_score_fraud": guarded_z(
                F.col("fraud_rate_30d"), F.col("historical_fraud_rate"), F.col("historical_fraud_stddev")
            ),
            "risk_interaction": interact(F.col("fraud_rate_30d"), F.col("chargeback_rate_30d")),
            "decline_x_fraud": interact(F.col("decline_rate_30d"), F.col("fraud_rate_30d")),
        }
    ).select(
        *ON, "industry", "state", *[c for c in FEATURE_COLUMNS if percentile or c != "p95_amount_30d"],
        *([] if label is None else [LABEL]),
    )
