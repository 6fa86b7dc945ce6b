"""The training frame of the modelling step: calendar-month features and instant-clock windows.

It shares column names with the feature table of ``plans.features`` but not the definitions: "30d" and service
columns are calendar months, windows end at midnight before the last day, and nothing is multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.config import KEY, LABEL, MONTH, LabelRule, Spine
from tillwatch.functions.columns import (
    flag_stddev,
    from_cents,
    guarded_z,
    interact,
    or_zero,
    ratio,
    sample_stddev,
)
from tillwatch.operators.deltas import by_month, lag_delta
from tillwatch.operators.rollup import daily_activity
from tillwatch.operators.windows import all_months, future_totals, month_members, past_months, transaction_windows
from tillwatch.plans.labels import SUMS, default_label, rate_columns

ON = [KEY, MONTH]


def _instant_rollup(txns: DataFrame | None = None, sla: DataFrame | None = None) -> DataFrame:
    return daily_activity(txns, sla, clock="ts")


def _seen_by_calendar(as_written: bool) -> Column:
    """``as_written`` keeps only events stamped exactly midnight: the original adds the time of day to the month end
    and then loses every other row in the join on midnight. In the rollup those are the rows whose window day is
    their own date."""
    return F.col("day") == F.col("date") if as_written else F.lit(True)


_CALENDAR_TXN = ("n_txn", "n_txn_id", "approved", "declined", "n_fraud", "fraud", "n_chargeback", "chargeback")
_CALENDAR_SLA = ("n_sla", "n_event", "n_breached", "breached")


def _month_totals(names: tuple[str, ...], counts: Column) -> list[Column]:
    return [F.coalesce(F.sum(F.when(counts, F.col(n))), F.lit(0)).alias(f"month_{n}") for n in names]


def _month_ratio(part: str, whole: str) -> Column:
    return ratio(F.col(f"month_{part}"), F.col(f"month_{whole}"))


def _calendar_columns() -> list[Column]:
    return [
        F.col("month_n_txn_id").alias("txn_count_30d"),
        from_cents(F.col("month_approved")).alias("gmv_30d"),
        _month_ratio("declined", "n_txn").alias("decline_rate_30d"),
        _month_ratio("fraud", "n_fraud").alias("fraud_rate_30d"),
        _month_ratio("chargeback", "n_chargeback").alias("chargeback_rate_30d"),
    ]


def _calendar_sla_columns() -> list[Column]:
    return [
        F.col("month_n_event").alias("sla_events_60d"),
        _month_ratio("breached", "n_breached").alias("sla_breach_rate_60d"),
    ]


def _by_calendar_month(daily: DataFrame, names: tuple[str, ...], as_written: bool) -> DataFrame:
    rows = daily.where((F.col(names[0]) > 0) & _seen_by_calendar(as_written))
    return rows.groupBy(KEY, F.last_day("date").alias(MONTH)).agg(*_month_totals(names, F.lit(True)))


def calendar_month_features(txns: DataFrame, as_written: bool = False) -> DataFrame:
    """Payments per merchant and calendar month, for months that have any."""
    return _by_calendar_month(_instant_rollup(txns), _CALENDAR_TXN, as_written).select(*ON, *_calendar_columns())


def calendar_month_sla(sla: DataFrame, as_written: bool = False) -> DataFrame:
    """Service events per merchant and calendar month, for months that have any."""
    return _by_calendar_month(_instant_rollup(sla=sla), _CALENDAR_SLA, as_written).select(
        *ON, *_calendar_sla_columns()
    )


WINDOW_COLUMNS = (
    "fraud_rate_60d", "chargeback_rate_60d", "cumulative_fraud_90d", "amount_volatility_90d", "decline_rate_90d",
    "rolling_max_decline_spike", "historical_fraud_rate", "historical_fraud_std",
)


def _window_columns() -> list[Column]:
    to_date = by_month().rowsBetween(Window.unboundedPreceding, 0)
    hits, n = F.sum("new_fraud").over(to_date), F.sum("new_n_fraud").over(to_date)
    return [
        ratio(F.col("fraud_60"), F.col("n_fraud_60")).alias("fraud_rate_60d"),
        ratio(F.col("chargeback_60"), F.col("n_chargeback_60")).alias("chargeback_rate_60d"),
        F.when(F.col("n_txn_90") > 0, F.col("fraud_90")).alias("cumulative_fraud_90d"),
        from_cents(sample_stddev(F.col("dev_cents_90"), F.col("n_cents_90"))).alias("amount_volatility_90d"),
        ratio(F.col("declined_90"), F.col("n_txn_90")).alias("decline_rate_90d"),
        F.col("spike_90").alias("rolling_max_decline_spike"),
        ratio(hits, n).alias("historical_fraud_rate"),
        flag_stddev(hits, n).alias("historical_fraud_std"),
    ]


def ts_window_features(txns: DataFrame, merchants: DataFrame, spine: Spine = Spine()) -> DataFrame:
    """60-day, 90-day and all-time features with instant bounds; NULL where a window is empty."""
    daily = daily_activity(txns, txn_days=spine.history(), clock="ts")
    months = past_months(F.col("day"), 90, spine, history=True)
    members = month_members(daily, merchants, months, spine.history(), spine, halves=True)
    return transaction_windows(members, (60, 90), split_days=True).select(*ON, *_window_columns())


def fill_zero(frame: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs of the given columns become 0."""
    return frame.fillna({c: 0 for c in columns})


CALENDAR_COLUMNS = (
    "txn_count_30d", "gmv_30d", "decline_rate_30d", "fraud_rate_30d", "chargeback_rate_30d", "sla_events_60d",
    "sla_breach_rate_60d", LABEL,
)


def training_frame(
    txns: DataFrame,
    sla: DataFrame,
    merchants: DataFrame,
    spine: Spine = Spine(),
    rule: LabelRule = LabelRule(),
    as_written: bool = False,
    daily: DataFrame | None = None,
) -> DataFrame:
    """Spine, industry, features and label of every merchant-month, zero where nothing happened.

    One rollup (``daily_activity(txns, sla, clock="ts")``, or ``daily`` if it is at hand) and one grouped aggregation
    give calendar months, past windows and the forward label together.
    """
    daily = _instant_rollup(txns, sla) if daily is None else daily
    ahead, back = 60, 90
    months = all_months(F.col("day"), back, ahead, spine)
    members = month_members(daily, merchants, months, spine.history(ahead), spine, halves=True)
    in_month = (F.last_day("date") == F.col(MONTH)) & _seen_by_calendar(as_written)
    totals = (*_month_totals(_CALENDAR_TXN + _CALENDAR_SLA, in_month), *future_totals(SUMS, ahead))
    frame = transaction_windows(members, (60, back), split_days=True, extra=totals).select(
        *ON, *_calendar_columns(), *_calendar_sla_columns(), *rate_columns(False), *_window_columns()
    )
    frame = default_label(frame, rule).select(*ON, *CALENDAR_COLUMNS, *WINDOW_COLUMNS)
    frame = fill_zero(frame, list(CALENDAR_COLUMNS))
    frame = frame.withColumns(
        {
            "prev_fraud_rate": or_zero(F.lag("fraud_rate_30d").over(by_month())),
            "prev_cb_rate": or_zero(F.lag("chargeback_rate_30d").over(by_month())),
        }
    )
    frame = lag_delta(
        frame, {"fraud_acceleration": "fraud_rate_30d", "chargeback_acceleration": "chargeback_rate_30d"}
    ).withColumns(
        {
            "z_score_fraud": guarded_z(
                F.col("fraud_rate_30d"), F.col("historical_fraud_rate"), F.col("historical_fraud_std")
            ),
            "risk_interaction": interact(F.col("fraud_rate_30d"), F.col("chargeback_rate_30d")),
            "decline_x_fraud": interact(F.col("decline_rate_30d"), F.col("fraud_rate_30d")),
        }
    )
    return fill_zero(
        frame.join(merchants.select(KEY, "industry"), KEY),
        [
            "cumulative_fraud_90d", "amount_volatility_90d", "rolling_max_decline_spike", "decline_rate_90d",
            "fraud_rate_60d", "chargeback_rate_60d", "fraud_acceleration", "chargeback_acceleration",
            "z_score_fraud", "risk_interaction", "decline_x_fraud",
        ],
    )
