"""Running totals over a global order, without sorting everything into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 256


def running_totals(
    rows: DataFrame, order: str, totals: dict[str, Column], descending: bool = True, buckets: int = BUCKETS
) -> DataFrame:
    """One row per distinct ``order`` value with each total and its running sum ``cum_<name>``.

    Equal values are aggregated map-side first, so a value shared by a third of all rows is one row from there on.
    The distinct values are split into buckets at the values of smallest hash, which is a uniform draw whatever the
    type or distribution; running sums are taken inside the buckets in parallel and shifted by the totals of the
    buckets before. Only the cuts and the bucket totals, at most ``buckets`` rows, meet in one task. Where the cuts
    fall affects the balance of the work, never the result. ``all_<name>`` is the total over everything.
    """
    distinct = rows.where(F.col(order).isNotNull()).groupBy(order).agg(*[t.alias(n) for n, t in totals.items()])
    cuts = (
        distinct.orderBy(F.xxhash64(order))
        .limit(buckets - 1)
        .agg(F.sort_array(F.collect_list(order)).alias("cuts"))
        .scalar()
    )
    # place of the value among the sorted cuts; the constant makes it a column without NULLs, so that the join below
    # adds no filter on it that would move under the aggregation and run once per row
    place = F.array_position(F.sort_array(F.array_append(cuts, F.col(order))), F.col(order))
    bucketed = distinct.withColumn("bucket", F.coalesce(place, F.lit(0).cast("bigint")))

    def direction(column):
        return F.col(column).desc() if descending else F.col(column).asc()

    inside = Window.partitionBy("bucket").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    in_order = Window.orderBy(direction("bucket"))
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = (
        bucketed.groupBy("bucket")
        .agg(*[F.sum(n).alias(n) for n in totals])
        .select(
            "bucket",
            *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"before_{n}") for n in totals],
            *[F.sum(n).over(whole).alias(f"all_{n}") for n in totals],
        )
    )
    # at most `buckets` rows by construction
    joined = bucketed.join(F.broadcast(offsets), "bucket")
    running = {f"cum_{n}": F.sum(n).over(inside) + F.col(f"before_{n}") for n in totals}
    return joined.withColumns(running).select(order, *totals, *running, *[f"all_{n}" for n in totals])
