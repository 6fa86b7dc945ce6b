"""Column expressions shared by the operators; all of them stay in whole-stage code generation."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as double; NULL where ``whole`` is 0, like the mean of no values."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def or_zero_double(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def is_value(column: Column, value: str) -> Column:
    """1/0 flag that stays NULL for a NULL input."""
    return (column == value).cast("int")


def to_cents(amount: Column) -> Column:
    """Money with two decimals as an exact long, so sums stay exact and primitive."""
    return (amount.cast("decimal(12,2)") * 100).cast("bigint")


def from_cents(cents: Column) -> Column:
    return cents.cast("double") / F.lit(100.0)


def sample_stddev(m2: Column, n: Column, copies: Column | None = None) -> Column:
    """Sample standard deviation from the sum of squared deviations ``m2`` of ``n`` values.

    With ``copies`` the value is that of a set holding every value ``copies`` times. NULL below two values.
    """
    k = F.lit(1) if copies is None else copies
    total = n * k
    return F.when(total > 1, F.sqrt(m2 * k / (total - 1)))


def flag_stddev(hits: Column, n: Column) -> Column:
    """Sample standard deviation of a 0/1 flag with ``hits`` ones among ``n``; exactly 0 for a constant flag."""
    h, c = hits.cast("double"), n.cast("double")
    return F.when(n > 1, F.sqrt(h * (c - h) / c / (c - 1.0)))


def guarded_z(x: Column, mean: Column, sd: Column) -> Column:
    """Z-score, 0 where the deviation is 0 or unknown."""
    return F.when(sd > 0, (x - mean) / sd).otherwise(F.lit(0.0))


def interact(a: Column, b: Column) -> Column:
    return a * b


def window_day(ts: Column, clock: str) -> Column:
    """The day an event counts for in a window ``(end - W, end]``.

    ``clock="date"`` compares calendar dates. ``clock="ts"`` compares instants with midnight bounds: everything
    after midnight counts for the next day, so day arithmetic on the result equals the instant comparison.
    """
    day = F.to_date(ts)
    if clock == "date":
        return day
    if clock == "ts":
        return F.when(is_midnight(ts), day).otherwise(F.date_add(day, 1))
    raise ValueError(f"clock must be 'date' or 'ts', not {clock!r}")


def is_midnight(ts: Column) -> Column:
    return ts.cast("timestamp_ntz") == F.to_date(ts).cast("timestamp_ntz")


def within_days(ts: Column, first: date | None, last: date | None, clock: str = "date") -> Column:
    """Filter on the raw timestamp for window days ``first`` to ``last``; literal bounds reach the Parquet scan."""
    lead = 0 if clock == "date" else 1
    keep = F.lit(True)
    if first is not None:
        keep = keep & (ts >= F.lit(f"{first - timedelta(days=lead)} 00:00:00").cast("timestamp_ntz"))
    if last is not None:
        keep = keep & (ts < F.lit(f"{last + timedelta(days=1)} 00:00:00").cast("timestamp_ntz"))
    return keep


def skip_nan(value: Column) -> Column:
    """NaN to NULL, for functions that must ignore it."""
    return F.when(~F.isnan(value), value)
