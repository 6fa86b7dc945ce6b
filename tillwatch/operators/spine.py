"""Month spines: one row per entity and reporting month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.config import KEY, MONTH, Spine


def month_starts(first: Column, last: Column) -> Column:
    """Array of month starts from ``first`` to ``last``; empty if the range is."""
    months = F.sequence(first, last, F.expr("interval 1 month"))
    return F.when(first <= last, months).otherwise(F.array().cast("array<date>"))


def month_spine(entities: DataFrame, spine: Spine = Spine(), key: str = KEY) -> DataFrame:
    """Every entity in every month, whether or not it was active."""
    starts = month_starts(F.lit(spine.first), F.lit(spine.last))
    return entities.select(key, F.explode(starts).alias("month_start")).withColumn(
        MONTH, F.last_day("month_start")
    )


def month_spine_ends(entities: DataFrame, spine: Spine = Spine(), key: str = KEY) -> DataFrame:
    """Month ends per distinct entity."""
    return month_spine(entities.select(key).distinct(), spine, key).select(key, MONTH)
