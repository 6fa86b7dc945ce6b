"""Splitting a portfolio target over merchants."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Daily payments by risk tier, and the industry multiplier.
TIER_RATE = {"LOW": 25, "MED": 45, "HIGH": 80}
INDUSTRY_MULTIPLIER = {
    "Retail": Decimal("1.0"),
    "Travel": Decimal("0.7"),
    "Subscription": Decimal("1.2"),
    "Marketplace": Decimal("1.1"),
    "DigitalGoods": Decimal("1.3"),
}


def _lookup(values: dict, column: str):
    pairs = [F.lit(x) for pair in values.items() for x in pair]
    return F.create_map(*pairs)[F.col(column)]


def proportional_allocation(
    merchants: DataFrame, target: int = 400_000, start: date = date(2025, 1, 1), end: date = date(2025, 12, 31)
) -> DataFrame:
    """Adds ``txn_count``: the target split by tier rate, industry multiplier and active days, rounded down.

    Weights are decimals, so their total does not depend on the order of summing.
    """
    days = F.least(
        F.lit((end - start).days),
        F.greatest(F.lit(1), F.datediff(F.lit(end), F.greatest(F.lit(start), F.col("onboard_date")))),
    )
    weight = (_lookup(TIER_RATE, "risk_tier_true") * _lookup(INDUSTRY_MULTIPLIER, "industry") * days).cast("decimal(20,1)")
    weighted = merchants.withColumn("weight", weight)
    scale = F.lit(float(target)) / weighted.agg(F.sum("weight").cast("double")).scalar()
    count = F.floor(F.col("weight").cast("double") * scale).cast("bigint")
    return weighted.withColumn("txn_count", count).drop("weight")
