"""Declared schemas and the constraints that Spark itself does not enforce."""

from __future__ import annotations

from pyspark.sql import types as T

MERCHANTS = T.StructType(
    [
        T.StructField("merchant_id", T.StringType()),
        T.StructField("industry", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("onboard_date", T.DateType()),
        T.StructField("risk_tier_true", T.StringType()),
    ]
)

TRANSACTIONS = T.StructType(
    [
        T.StructField("txn_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("txn_ts", T.TimestampNTZType()),
        T.StructField("amount", T.DecimalType(12, 2)),
        T.StructField("channel", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("is_fraud", T.IntegerType()),
        T.StructField("is_chargeback", T.IntegerType()),
    ]
)

SLA_EVENTS = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("merchant_id", T.StringType()),
        T.StructField("event_ts", T.TimestampNTZType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("breached", T.IntegerType()),
    ]
)

OUTCOMES = T.StructType(
    [
        T.StructField("merchant_id", T.StringType()),
        T.StructField("month_end", T.DateType()),
        T.StructField("default_next_60d", T.IntegerType()),
    ]
)

# Primary keys, foreign keys to merchants, and allowed values of each table.
PRIMARY_KEYS = {
    "merchants": ["merchant_id"],
    "transactions": ["txn_id"],
    "sla_events": ["event_id"],
    "outcomes_monthly": ["merchant_id", "month_end"],
}
FOREIGN_KEYS = {
    "transactions": ["txn_id"],
    "sla_events": ["event_id"],
    "outcomes_monthly": ["merchant_id", "month_end"],
}
NOT_NULL = {
    "merchants": MERCHANTS.fieldNames(),
    "transactions": TRANSACTIONS.fieldNames(),
    "sla_events": SLA_EVENTS.fieldNames(),
    "outcomes_monthly": OUTCOMES.fieldNames(),
}
FLAG_VALUES = (0, 1)
DOMAINS = {
    "merchants": {"risk_tier_true": ("LOW", "MED", "HIGH")},
    "transactions": {
        "channel": ("CARD", "ACH"),
        "status": ("APPROVED", "DECLINED"),
        "is_fraud": FLAG_VALUES,
        "is_chargeback": FLAG_VALUES,
    },
    "sla_events": {
        "event_type": ("DISPUTE_RESPONSE_DELAY", "SETTLEMENT_DELAY", "DOC_REQUEST_MISSED"),
        "breached": FLAG_VALUES,
    },
    "outcomes_monthly": {"default_next_60d": FLAG_VALUES},
}
