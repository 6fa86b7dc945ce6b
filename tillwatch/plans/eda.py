"""Exploratory reports over the scored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.config import KEY, LABEL, REPORT_FEATURES


def rate_by(df: DataFrame, column: str, label: str = LABEL) -> DataFrame:
    """Mean label per value of a column, highest first; rows without a value are in no group."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.avg(label).alias("default_rate"))
        .orderBy(F.col("default_rate").desc(), column)
    )


def rate_by_tier(scored: DataFrame, merchants: DataFrame, label: str = LABEL) -> DataFrame:
    """Mean label per risk tier; merchants that are not known form no tier.

    Labels are summed per merchant before the join, so that what is shuffled is one row per merchant.
    """
    per_merchant = scored.groupBy(KEY).agg(F.sum(label).alias("hits"), F.count(label).alias("n"))
    return (
        per_merchant.join(merchants.select(KEY, "risk_tier_true"), KEY, "left")
        .where(F.col("risk_tier_true").isNotNull())
        .groupBy("risk_tier_true")
        .agg(F.try_divide(F.sum("hits").cast("double"), F.sum("n").cast("double")).alias("default_rate"))
    )


def _long(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull() & ~F.isnan("value"))


def histograms(df: DataFrame, columns: tuple[str, ...] = REPORT_FEATURES, bins: int = 40) -> DataFrame:
    """``(feature, bin, bin_start, bin_end, n)``: equal-width bins from minimum to maximum, the last one closed.

    A constant feature gets the range value -0.5 to value +0.5. All bins of a feature that has a value have a row;
    NULL and NaN are no values.
    """

    def extent(column):
        value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
        return F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))

    names, extents = F.array(*[F.lit(c) for c in columns]), F.array(*[extent(c) for c in columns])
    ranges = df.agg(F.map_from_arrays(names, extents).alias("ranges")).scalar()
    span = ranges[F.col("feature")]
    constant = span["lo"] == span["hi"]
    lo = F.when(constant, span["lo"] - 0.5).otherwise(span["lo"])
    hi = F.when(constant, span["hi"] + 0.5).otherwise(span["hi"])
    placed = (
        _long(df, columns)
        .withColumns({"lo": lo, "hi": hi})
        .withColumn("bin", F.least(F.width_bucket("value", "lo", "hi", F.lit(bins)), F.lit(bins)).cast("int"))
    )
    width = (F.col("hi") - F.col("lo")) / bins
    # every bin of every feature once, beside the counted ones
    grid = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("feature"))
    grid = grid.withColumns({"lo": lo, "hi": hi}).where(F.col("lo").isNotNull())
    empty = grid.select("feature", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "lo", "hi", F.lit(0).alias("hit"))
    return (
        placed.select("feature", "bin", "lo", "hi", F.lit(1).alias("hit"))
        .unionByName(empty)
        .groupBy("feature", "bin", "lo", "hi")
        .agg(F.sum("hit").alias("n"))
        .select(
            "feature",
            "bin",
            (F.col("lo") + width * (F.col("bin") - 1)).alias("bin_start"),
            (F.col("lo") + width * F.col("bin")).alias("bin_end"),
            "n",
        )
    )


def class_balance(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows per class and their share; the share of class 1 is the default rate."""
    total = df.agg(F.count(label)).scalar()
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("share", F.col("n").cast("double") / total.cast("double"))
    )


def correlations(df: DataFrame, columns: tuple[str, ...] = REPORT_FEATURES, label: str = LABEL) -> DataFrame:
    """Pearson correlation of each feature, and of the label itself, with the label; NULL for a constant feature."""
    names = [*columns, label]
    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))  # noqa: E731  pairs with NaN are skipped
    y = known(label)
    found = df.agg(*[F.corr(known(c), y).alias(f"c{i}") for i, c in enumerate(names)])
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("correlation")) for i, c in enumerate(names)]
    )
    return found.select(F.inline(pairs)).orderBy(F.col("correlation").desc_nulls_last(), "feature")
