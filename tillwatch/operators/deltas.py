"""Month-over-month changes per entity; a window partition is one entity's months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.config import KEY, MONTH


def by_month(key: str = KEY) -> Window:
    return Window.partitionBy(key).orderBy(MONTH)


def calendar_previous(columns: list[str], key: str = KEY, snap: bool = False) -> list[Column]:
    """Values of the month at ``month_end`` minus one month, NULL where there is no such month end.

    The subtraction keeps the day of the month: 30 April gives 30 March, which is no month end, so only months of 31
    days find their predecessor. ``snap`` moves the result to the month end and always finds it. Months of one key
    must be unique; then the only row that can match is the one before.
    """
    order = by_month(key)
    target = F.add_months(F.col(MONTH), -1)
    found = F.lag(MONTH).over(order) == (F.last_day(target) if snap else target)
    return [F.when(found, F.lag(column).over(order)) for column in columns]


def mom_delta(frame: DataFrame, columns: dict[str, str], key: str = KEY, snap: bool = False) -> DataFrame:
    """``{new name: column}`` as change against the calendar month before, a missing month counting as 0."""
    before = calendar_previous(list(columns.values()), key, snap)
    return frame.withColumns(_changes(columns, before))


def lag_delta(frame: DataFrame, columns: dict[str, str], key: str = KEY) -> DataFrame:
    """``{new name: column}`` as change against the previous row of the key, the first row against 0."""
    order = by_month(key)
    return frame.withColumns(_changes(columns, [F.lag(column).over(order) for column in columns.values()]))


def _changes(columns: dict[str, str], before: list[Column]) -> dict[str, Column]:
    zero = F.lit(0)
    return {name: F.col(now) - F.coalesce(old, zero) for (name, now), old in zip(columns.items(), before)}
