"""Stand-in tables: an order-processing data set read as merchants, payments and service events.

Suppliers play merchants, line items play payments and orders play service events.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.config import LabelRule, RuleBook, Spine

# All months of the data, so that every payment and event is in some window.
SPINE = Spine(date(1995, 1, 1), date(2001, 12, 1))
# Thresholds at which every clause fires on this data (about 14 payments per 60 days and merchant).
LABEL_RULE = LabelRule(chargeback=0.15, fraud=0.18, decline=0.25, fraud_count=10, sla=0.40, txn_count=50)
RULE_BOOK = RuleBook(txn_count=9)
GRID_CHARGEBACK = (0.10, 0.12, 0.15, 0.18, 0.20)
GRID_FRAUD = (0.12, 0.15, 0.18, 0.20, 0.25)
AS_OF = "2001-06-01 00:00:00"
# Month ends up to here train, later ones test.
CUT = date(2000, 9, 30)


@dataclass(frozen=True)
class StandIn:
    """The tables of one data directory."""

    spark: SparkSession
    folder: str

    def _raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def merchants(self) -> DataFrame:
        kind = F.col("s_nationkey") % 5
        return (
            self._raw("supplier")
            .join(self._raw("nation").select("n_nationkey"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("s_suppkey").alias("merchant_id"),
                F.when(kind == 0, "Retail")
                .when(kind == 1, "Travel")
                .when(kind == 2, "Subscription")
                .when(kind == 3, "Marketplace")
                .otherwise("DigitalGoods")
                .alias("industry"),
                F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("state"),
                F.date_add(F.lit(date(1999, 7, 5)), (F.col("s_suppkey") % 210).cast("int")).alias("onboard_date"),
                F.when(F.col("s_acctbal") < 500, "HIGH")
                .when(F.col("s_acctbal") < 3000, "MED")
                .otherwise("LOW")
                .alias("risk_tier_true"),
            )
        )

    @cached_property
    def merchants_sparse(self) -> DataFrame:
        """A parent table with gaps, so that orphans occur."""
        return self.merchants.where(F.col("merchant_id") % 10 != 0)

    @cached_property
    def transactions(self) -> DataFrame:
        minute = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 1440).cast("int")
        declined = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
        low = (F.col("l_discount") <= 0.015) & (F.col("l_tax") <= 0.015)
        high = (F.col("l_discount") >= 0.085) & (F.col("l_tax") >= 0.065)
        return self._raw("lineitem").select(
            F.concat(
                F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")
            ).alias("txn_id"),
            F.col("l_suppkey").alias("merchant_id"),
            (F.col("l_shipdate") + F.make_dt_interval(F.lit(0), F.lit(0), minute, F.lit(0))).alias("txn_ts"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"),
            F.when(F.col("l_returnflag") == "A", "ACH").otherwise("CARD").alias("channel"),
            F.when(declined, "DECLINED").otherwise("APPROVED").alias("status"),
            F.when(high, 1).otherwise(0).alias("is_fraud"),
            F.when(low & ~declined, 1).otherwise(0).alias("is_chargeback"),
        )

    @cached_property
    def sla_events(self) -> DataFrame:
        hour = ((F.col("o_orderkey") * 13) % 24).cast("int")
        urgent = F.col("o_orderpriority") == "1-URGENT"
        return self._raw("orders").select(
            F.col("o_orderkey").alias("event_id"),
            F.expr("o_custkey div 15").alias("merchant_id"),
            (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), hour, F.lit(0), F.lit(0))).alias("event_ts"),
            F.when(urgent, "DISPUTE_RESPONSE_DELAY")
            .when(F.col("o_orderpriority") == "2-HIGH", "SETTLEMENT_DELAY")
            .otherwise("DOC_REQUEST_MISSED")
            .alias("event_type"),
            F.when(urgent & (F.col("o_orderstatus") == "F"), 1).otherwise(0).alias("breached"),
        )
