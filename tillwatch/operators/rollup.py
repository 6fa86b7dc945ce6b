"""Day rollup of raw events: the only place where raw rows are shuffled for windows and labels.

Raw events are spread by (key, day) and reduced to one row each. A merchant holding a third of all events is spread over
its days, and is no more than one row per day from there on, so everything built on the rollup is free of that skew.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.config import KEY, MONTH_PARTITION, Days
from tillwatch.functions.columns import is_value, or_zero, ratio, to_cents, window_day, within_days
from tillwatch.session import stored_bytes

ALL_DAYS: Days = (None, None)
#: bytes of Parquet files for one task: some 250,000 payments, whose groups take about 200 MB
PART_BYTES = 4 << 20
#: partitions beyond which a shuffle has more blocks than rows are worth (80 GB of files); tasks grow, and may spill, from there on
MOST_PARTS = 20_000


def _day_columns(ts: Column, clock: str) -> list[Column]:
    """The window day, and the calendar date too where the two differ."""
    day = window_day(ts, clock).alias("day")
    return [day] if clock == "date" else [day, F.to_date(ts).alias("date")]


def events_between(events: DataFrame, ts: str, days: Days, key: str = KEY, clock: str = "date") -> DataFrame:
    """Events with a key whose window day is in ``days`` (or just outside).

    Literal bounds on the timestamp reach the scan. A table partitioned by month, as ``save_transactions`` writes it,
    is also pruned to the months of the range.
    """
    kept = events.where(F.col(key).isNotNull() & within_days(F.col(ts), *days, clock))
    if MONTH_PARTITION in events.columns:
        first, last = days
        if first is not None:
            kept = kept.where(f"{MONTH_PARTITION} >= date'{(first - timedelta(days=1)).replace(day=1)}'")
        if last is not None:
            kept = kept.where(f"{MONTH_PARTITION} <= date'{last.replace(day=1)}'")
    return kept


def _transaction_measures(txns: DataFrame, key: str, days: Days, clock: str) -> DataFrame:
    ts, cents = F.col("txn_ts"), to_cents(F.col("amount"))
    return events_between(txns, "txn_ts", days, key, clock).select(
        F.col(key),
        *_day_columns(ts, clock),
        F.lit(1).alias("txn"),
        F.col("txn_id").isNotNull().cast("int").alias("txn_id"),
        F.col("status").isNotNull().cast("int").alias("status"),
        is_value(F.col("status"), "DECLINED").alias("declined"),
        F.when(F.col("status") == "APPROVED", cents).alias("approved"),
        cents.alias("cents"),
        F.col("channel").isNotNull().cast("int").alias("channel"),
        is_value(F.col("channel"), "ACH").alias("ach"),
        F.col("is_fraud"),
        F.col("is_chargeback"),
    )


def _sla_measures(events: DataFrame, key: str, days: Days, clock: str) -> DataFrame:
    ts = F.col("event_ts")
    return events_between(events, "event_ts", days, key, clock).select(
        F.col(key),
        *_day_columns(ts, clock),
        F.lit(1).alias("sla"),
        F.col("event_id").isNotNull().cast("int").alias("event_id"),
        F.col("breached"),
    )


def daily_activity(
    txns: DataFrame | None = None,
    sla: DataFrame | None = None,
    key: str = KEY,
    txn_days: Days = ALL_DAYS,
    sla_days: Days = ALL_DAYS,
    clock: str = "date",
) -> DataFrame:
    """One row per (key, window day) with counts, sums and sums of squares.

    Under the instant clock a window day covers parts of two calendar dates; then the rows are per (key, day, date).
    Transactions and service events go through one shared shuffle, as the narrow rows they are: few merchants have many
    payments a day, so totals made before it would be nearly as many rows, three times as wide, and a scan task would
    have to hold them all. Unused measures are pruned by the optimizer, down to the columns read from the files. Money is in cents; its squares are exact decimals of 37 digits, room for
    10^13 payments of the largest amount.
    """
    parts = []
    if txns is not None:
        parts.append((_transaction_measures(txns, key, txn_days, clock), _transaction_totals()))
    if sla is not None:
        parts.append((_sla_measures(sla, key, sla_days, clock), _sla_totals()))
    rows = parts[0][0]
    for other, _ in parts[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    totals = [column for _, columns in parts for column in columns]
    days = ["day"] if clock == "date" else ["day", "date"]
    return rows.repartition(partitions(rows), key, "day").groupBy(key, *days).agg(*totals)


def partitions(rows: DataFrame, stored: int | None = None) -> int:
    """Partitions of a shuffle that a hash aggregation follows: one for every ``PART_BYTES`` of files that ``rows`` reads.

    At least the session's number, and not merged: merging goes by the bytes shuffled, and the aggregation right behind
    holds several times as many. A session's number is the same for any input, so alone it would let the rows of a task,
    and with them what a task spills, grow with the data. ``stored`` takes the place of the files' bytes.
    """
    needed = -(-(stored_bytes(rows) if stored is None else stored) // PART_BYTES)
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(needed, MOST_PARTS))


def _square(cents: str) -> Column:
    """Exact square; as a long where it fits, which all but the largest amounts do."""
    value, wide = F.col(cents), F.col(cents).cast("decimal(13,0)")
    return F.when(F.abs(value) < 3_000_000_000, (value * value).cast("decimal(27,0)")).otherwise(wide * wide)


def _transaction_totals():
    return [
        F.count("txn").alias("n_txn"),
        or_zero(F.sum("txn_id")).alias("n_txn_id"),
        or_zero(F.sum("status")).alias("n_status"),
        or_zero(F.sum("declined")).alias("declined"),
        F.count("approved").alias("n_approved"),
        or_zero(F.sum("approved")).alias("approved"),
        F.sum(_square("approved")).alias("sq_approved"),
        F.count("cents").alias("n_cents"),
        or_zero(F.sum("cents")).alias("cents"),
        F.sum(_square("cents")).alias("sq_cents"),
        or_zero(F.sum("channel")).alias("n_channel"),
        or_zero(F.sum("ach")).alias("ach"),
        F.count("is_fraud").alias("n_fraud"),
        or_zero(F.sum("is_fraud")).alias("fraud"),
        F.count("is_chargeback").alias("n_chargeback"),
        or_zero(F.sum("is_chargeback")).alias("chargeback"),
    ]


def _sla_totals():
    return [
        F.count("sla").alias("n_sla"),
        or_zero(F.sum("event_id")).alias("n_event"),
        F.count("breached").alias("n_breached"),
        or_zero(F.sum("breached")).alias("breached"),
    ]


def daily_declines(txns: DataFrame, key: str = KEY) -> DataFrame:
    """Decline rate and number of payments per merchant and day."""
    return daily_activity(txns, key=key).select(
        key,
        F.col("day").alias("txn_date"),
        ratio(F.col("declined"), F.col("n_status")).alias("daily_dec"),
        F.col("n_txn").alias("daily_txns"),
    )
