"""Month-end windows over the day rollup.

A range join "events within W days of a month end" pairs every event of a merchant with every month. Here each
day row is instead copied to the few month ends whose window holds it (at most 2, 3 or 4 for 30, 60 or 90 days), and
all windows become one grouped aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwatch.config import KEY, MONTH, Days, Spine
from tillwatch.operators.rollup import partitions
from tillwatch.operators.spine import month_starts
from tillwatch.session import stored_bytes


def _month_of(day: Column) -> Column:
    return F.trunc(day, "MM")


def past_months(day: Column, width: int, spine: Spine, history: bool = False) -> Column:
    """Starts of the spine months whose window ``(end - width, end]`` may hold ``day``.

    With ``history`` the month in which ``day`` first counts as past is always among them, also for days long
    before the spine.
    """
    first = F.greatest(_month_of(day), F.lit(spine.first))
    last = F.least(_month_of(F.date_add(day, width - 1)), F.lit(spine.last))
    return month_starts(first, F.greatest(last, first) if history else last)


def all_months(day: Column, back: int, ahead: int, spine: Spine) -> Column:
    """Months that see ``day`` in their past (``back`` days or history) or in their next ``ahead`` days.

    For days up to ``ahead`` days after the spine.
    """
    first = F.greatest(_month_of(F.date_sub(day, ahead)), F.lit(spine.first))
    last = F.greatest(F.least(_month_of(F.date_add(day, back - 1)), F.lit(spine.last)), first)
    return month_starts(first, last)


def future_months(day: Column, width: int, spine: Spine) -> Column:
    """Starts of the spine months whose window ``(end, end + width]`` may hold ``day``."""
    first = F.greatest(_month_of(F.date_sub(day, width)), F.lit(spine.first))
    last = F.least(_month_of(F.date_sub(day, 1)), F.lit(spine.last))
    return month_starts(first, last)


def past_members(rows: DataFrame, width: int, spine: Spine, day: str = "day") -> DataFrame:
    """Rows with each month end whose last ``width`` days hold them; ``age`` is the distance in days."""
    members = _at_month_ends(rows, past_months(F.col(day), width, spine), day)
    return members.where(F.col("age").between(0, width - 1))


def _at_month_ends(rows: DataFrame, months: Column, day: str) -> DataFrame:
    return rows.select("*", F.explode(months).alias("month_start")).select(
        *rows.columns, F.last_day("month_start").alias(MONTH), F.datediff(F.last_day("month_start"), day).alias("age")
    )


def month_members(
    daily: DataFrame,
    entities: DataFrame,
    months: Column,
    days: Days,
    spine: Spine,
    at_month: DataFrame | None = None,
    key: str = KEY,
    halves: bool = False,
) -> DataFrame:
    """Day rows, one anchor row per spine month, and optional ready-made merchant-month columns, side by side.

    All of them meet in one shuffle on the key, before the day rows are copied to their month ends, and the grouped
    aggregation that follows needs no other one: it takes the place of outer joins from the spine. A key has at most
    one row per day here, so the largest merchant is no larger than the number of days.

    ``months`` gives the month starts of a day row, ``days`` the first and last day that can have any (pushed down to
    the scan of a written rollup). ``at_month`` has key, month end and further columns. ``age`` is the number of days
    from a day row to the month end, NULL on the other rows.

    Under the instant clock a calendar date is two rows at most: midnight, and the rest of the date a day later.
    ``halves`` tells each of the other, before rows are copied: ``midnight_txn`` and ``midnight_declined`` on the rest,
    ``has_rest`` on midnight.
    """
    # an entity becomes a group for each month, held twice by the aggregation, however few days it has
    n_months = (spine.last.year - spine.first.year) * 12 + spine.last.month - spine.first.month + 1
    stored = stored_bytes(daily) + 2 * n_months * stored_bytes(entities)
    anchors = entities.select(key, F.lit(True).alias("anchor"))
    for bound, side in zip(days, (">=", "<=")):
        if bound is not None:
            daily = daily.where(f"day {side} date'{bound}'")
    rows = daily.unionByName(anchors, allowMissingColumns=True)
    if at_month is not None:
        ready = at_month.withColumn("ready_month", F.trunc(MONTH, "MM")).drop(MONTH)
        rows = rows.unionByName(ready, allowMissingColumns=True)
        months = F.when(F.col("ready_month").isNotNull(), F.array("ready_month")).otherwise(months)
    spine_months = month_starts(F.lit(spine.first), F.lit(spine.last))
    months = F.when(F.col("anchor"), spine_months).otherwise(months)
    rows = rows.repartition(partitions(rows, stored), key)
    if halves:
        in_order = Window.partitionBy(key).orderBy("date", "day")
        before = (F.lag("date").over(in_order) == F.col("date")) & (F.col("day") > F.col("date"))
        rows = rows.withColumns(
            {
                "midnight_txn": F.when(before, F.lag("n_txn").over(in_order)).otherwise(F.lit(0)),
                "midnight_declined": F.when(before, F.lag("declined").over(in_order)).otherwise(F.lit(0)),
                "has_rest": F.coalesce(F.lead("date").over(in_order) == F.col("date"), F.lit(False)),
            }
        )
    return _at_month_ends(rows, months, "day").withColumn(
        "is_new", F.col(MONTH) == F.greatest(F.last_day("day"), F.lit(spine.first_end))
    )


def at_anchors(members: DataFrame, totals: list[Column], key: str = KEY) -> DataFrame:
    """Totals per (key, month end) for the months of the spine.

    Totals should be numbers or dates: a text among them would turn the hash aggregation into a sorted one.
    """
    return (
        members.groupBy(key, MONTH)
        .agg(F.max("anchor").alias("anchor"), *totals)
        .where(F.col("anchor"))
        .drop("anchor")
    )


def _total(column: str, condition: str) -> str:
    return f"coalesce(sum({column}) FILTER (WHERE {condition}), 0L)"


def _past(width: int) -> str:
    return f"age BETWEEN 0 AND {width - 1}"


_TXN_TOTALS = (
    "n_txn", "n_txn_id", "n_status", "declined", "n_approved", "approved", "n_cents", "cents", "n_channel", "ach",
    "n_fraud", "fraud", "n_chargeback", "chargeback",
)
_SLA_TOTALS = ("n_event", "n_breached", "breached")


def transaction_windows(
    members: DataFrame,
    widths: tuple[int, ...],
    key: str = KEY,
    split_days: bool = False,
    busy_day: int = 3,
    extra: tuple[Column, ...] = (),
) -> DataFrame:
    """Window totals per (key, month end) of the spine for every width; columns are suffixed ``_<width>``.

    ``new_*`` columns are the totals of the days that the month end is the first one to see. ``split_days`` says that
    one calendar date may be spread over two rows, as under the instant clock (``members`` come with ``halves``); the
    decline share of a day is then taken over all its payments in the window, known status or not. ``extra`` are further aggregates of the same groups.

    ``dev_*`` are sums of squared deviations, ``(n * sum of squares - square of the sum) / n``. The difference is taken
    in whole cents, so no digits cancel, and everything comes from one grouped aggregation. It has 38 digits: enough
    for 10^7 payments of the largest amount in a window, or 10^11 of a thousand; beyond, the query stops.
    """
    per_day, totals, deviations = {}, {}, {}
    for w in widths:
        for money in ("approved", "cents"):
            n, squares = f"n_{money}_{w}", f"sq_{money}_{w}"
            total = f"CAST({money}_{w} AS decimal(19,0))"
            deviations[f"dev_{money}_{w}"] = f"try_divide(double({n} * {squares} - {total} * {total}), double({n}))"
            totals[squares] = f"sum(sq_{money}) FILTER (WHERE {_past(w)})"
        txns, declined, known = "n_txn", "declined", "n_status"
        if split_days:
            # the rest of a date speaks for both halves, as far as midnight is inside the window, too; midnight
            # speaks for itself where the rest is behind the window
            whole = "CASE WHEN day > date THEN {0} + CASE WHEN age <= {1} THEN {2} ELSE 0 END WHEN has_rest AND age >= 1 THEN NULL ELSE {0} END"
            txns, declined = whole.format("n_txn", w - 2, "midnight_txn"), whole.format("declined", w - 2, "midnight_declined")
            known = txns
        share = f"try_divide(double({declined}), double({known}))"
        per_day[f"spike_{w}"] = f"CASE WHEN ({txns}) >= {busy_day} THEN {share} END"

        sla = _SLA_TOTALS if "n_sla" in members.columns else ()
        totals |= {f"{name}_{w}": _total(name, _past(w)) for name in (*_TXN_TOTALS, *sla)}
        totals[f"spike_{w}"] = f"max(spike_{w}) FILTER (WHERE {_past(w)})"
        # the rollup has one row per active day, so counting rows counts days
        totals[f"days_{w}"] = f"count(*) FILTER (WHERE n_txn > 0 AND {_past(w)})"
    totals |= {f"new_{name}": _total(name, "is_new") for name in ("n_fraud", "fraud")}

    def columns(named: dict[str, str]) -> list[Column]:
        return [F.expr(text).alias(name) for name, text in named.items()]

    windows = at_anchors(members.select("*", *columns(per_day)), [*columns(totals), *extra], key)
    return windows.select("*", *columns(deviations)).drop(*(name for name in totals if name.startswith("sq_")))


def future_totals(names: tuple[str, ...], width: int) -> list[Column]:
    """Sums of rollup columns over the ``width`` days after the month end, named ``next_*``."""
    return [F.expr(_total(n, f"age BETWEEN {-width} AND -1")).alias(f"next_{n}") for n in names]


def past_totals(names: tuple[str, ...], width: int) -> list[Column]:
    """Sums of rollup columns over the ``width`` days up to the month end."""
    return [F.expr(_total(n, _past(width))).alias(n) for n in names]
