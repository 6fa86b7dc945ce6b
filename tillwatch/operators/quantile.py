"""Exact grouped percentiles without holding a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Values are whole numbers; a band of 2^16 of them holds at most that many distinct ones.
BAND_BITS = 16


def grouped_percentile(
    rows: DataFrame, keys: list[str], value: str, fraction: float, name: str, bits: int = BAND_BITS
) -> DataFrame:
    """Interpolated percentile (``PERCENTILE_CONT``) of a whole-number column per group, NULLs ignored.

    Equal values are counted map-side first, so a hot group spreads over the cluster by value. Then bands of 2^``bits``
    values are counted, from which the band (or the two) that holds the rank is known; only values of that band are
    sorted. No window partition holds more than 2^``bits`` rows (values) or the bands of one group, at most 2^24 for
    money of twelve digits, whatever the number of events in the group.

    The chosen bands, two a group at most, are joined to the counted values. The filters up front are those that the
    join would add to one side only; with them both uses of the counts are one plan, whose shuffle runs once.
    """
    with_band = rows.withColumn("band", F.shiftright(value, bits))
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, value, "band")])
    counted = with_band.where(known).groupBy(*keys, "band", value).agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*keys)
    bands = (
        counted.groupBy(*keys, "band")
        .agg(F.sum("n").alias("band_size"))
        .withColumn(
            "below",
            F.sum("band_size").over(group.orderBy("band").rowsBetween(Window.unboundedPreceding, 0))
            - F.col("band_size"),
        )
        .withColumn("position", F.lit(float(fraction)) * (F.sum("band_size").over(group) - 1))
        .withColumn("low", F.floor("position"))
        .withColumn("high", F.ceil("position"))
        # only the bands that hold one of the two neighbours are needed
        .where((F.col("low") < F.col("below") + F.col("band_size")) & (F.col("high") >= F.col("below")))
        .drop("band_size")
    )
    in_order = Window.partitionBy(*keys, "band").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(bands, [*keys, "band"]).withColumn("in_band", F.sum("n").over(in_order))
    last = F.col("below") + F.col("in_band") - 1
    start = last - F.col("n") + 1
    covers_low = F.col("low").between(start, last)
    covers_high = F.col("high").between(start, last)
    lower, upper = F.max(F.when(covers_low, F.col(value))), F.max(F.when(covers_high, F.col(value)))
    weight = F.max(F.col("position") - F.col("low"))
    return (
        ranked.where(covers_low | covers_high)
        .groupBy(*keys)
        .agg((lower + weight * (upper - lower)).alias(name))
    )
