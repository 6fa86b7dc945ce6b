"""Model dataset, reporting tables and the out-of-time split."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.config import KEY, LABEL, MONTH, Spine

ON = [KEY, MONTH]


def model_dataset(features: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Feature rows that have a label, from stored tables; ``merchant_month_features(label=...)`` makes it from events."""
    return features.join(outcomes.select(*ON, LABEL), ON, "inner")


def portfolio_overview(spine: DataFrame, features: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per month: merchants, payment volume and unweighted mean rates."""
    rates = features.select(*ON, "gmv_30d", "fraud_rate_30d", "chargeback_rate_30d", "sla_breach_rate_60d")
    return (
        spine.select(*ON)
        .join(rates, ON, "left")
        .join(outcomes.select(*ON, LABEL), ON, "left")
        .groupBy(MONTH)
        .agg(
            F.countDistinct(KEY).alias("total_merchants"),
            F.sum("gmv_30d").alias("total_gmv"),
            F.avg("fraud_rate_30d").alias("portfolio_fraud_rate"),
            F.avg("chargeback_rate_30d").alias("portfolio_chargeback_rate"),
            F.avg("sla_breach_rate_60d").alias("portfolio_sla_breach_rate"),
            F.avg(LABEL).alias("portfolio_default_risk"),
        )
        .orderBy(MONTH)
    )


def risk_queue_mart(spine: Spine, features: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Feature excerpt and label of the latest month of the spine.

    ``Spine.tail`` gives the two months that features of the latest one need.
    """
    return (
        features.where(F.col(MONTH) == F.lit(spine.last_end))
        .select(
            *ON, "industry", "state", "gmv_30d", "fraud_rate_30d", "chargeback_rate_30d", "decline_rate_30d",
            "sla_breach_rate_60d",
        )
        .join(outcomes.select(*ON, LABEL), ON, "left")
    )


def oot_split(
    frame: DataFrame,
    last_train_month: int = 9,
    cut: date | None = None,
    embargo_days: int = 0,
    spine: Spine | None = None,
) -> DataFrame:
    """Adds ``month`` and ``split``: month ends up to ``cut`` train, later ones test.

    Without ``cut``, calendar months up to ``last_train_month`` train, which is a cut in time only inside one year: a
    longer ``spine`` is refused. ``embargo_days`` leaves out test months so soon after the cut, as labels of the last
    training months look ahead into them.
    """
    month = F.month(MONTH)
    if cut is None:
        if spine is not None and spine.first.year != spine.last.year:
            raise ValueError("months of several years need a cut date")
        past = month <= last_train_month
    else:
        past = F.col(MONTH) <= F.lit(cut)
        if embargo_days:
            frame = frame.where(past | (F.col(MONTH) > F.date_add(F.lit(cut), embargo_days)))
    return frame.withColumn("month", month).withColumn("split", F.when(past, "train").otherwise("test"))


def train_part(split: DataFrame) -> DataFrame:
    return split.where(F.col("split") == "train")


def test_part(split: DataFrame) -> DataFrame:
    return split.where(F.col("split") == "test")
