"""Hard risk rules and the hybrid score, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwatch.config import RuleBook
from tillwatch.functions.columns import skip_nan

#: digits of a score. Equal scores are one point of a curve and one rank, so what is equal on paper has to be equal in
#: bits: sums in another order differ behind the 15th digit, and two scores that close are one score here.
SCORE_DIGITS = 9

# Separator between the reasons of one row.
REASON_SEPARATOR = " | "


def risk_rules(book: RuleBook = RuleBook()) -> list[tuple[Column, float, str]]:
    """(condition, points, reason) in the order in which points are added."""
    # Points and reason texts.
    return [
        (
            (F.col("chargeback_rate_30d") > book.chargeback_rate) & (F.col("gmv_30d") > book.gmv),
            0.4,
            "High CB & Vol",
        ),
        (F.col("sla_breach_rate_60d") > book.sla_breach_rate, 0.3, "SLA Breach"),
        (F.col("fraud_rate_30d") > book.fraud_rate, 0.4, "High Fraud Rate"),
        (F.col("txn_count_30d") > book.txn_count, 0.1, "High Vol"),
    ]


def rule_score(book: RuleBook = RuleBook()) -> Column:
    """Points added in rule order (the order fixes the rounding), capped at 1."""
    total = F.lit(0.0)
    for condition, points, _ in risk_rules(book):
        total = total + F.when(condition, F.lit(points)).otherwise(F.lit(0.0))
    return F.least(total, F.lit(1.0))


def rule_reason(book: RuleBook = RuleBook()) -> Column:
    """Reasons of the rules that fired, empty text if none did."""
    return F.concat_ws(REASON_SEPARATOR, *[F.when(c, F.lit(reason)) for c, _, reason in risk_rules(book)])


def hybrid_score(model: Column, rules: Column) -> Column:
    """The higher of model and rule score; a missing model score leaves the rule score."""
    return F.greatest(skip_nan(model), skip_nan(rules))


def resolved(score: Column) -> Column:
    """A score at the resolution in which scores are compared."""
    return F.round(score, SCORE_DIGITS)


def linear_score(weights: dict[str, float], intercept: float) -> Column:
    """Probability of a logistic model with given coefficients, at ``SCORE_DIGITS``."""
    total = F.lit(float(intercept))
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * F.col(name).cast("double")
    return resolved(F.lit(1.0) / (F.lit(1.0) + F.exp(-total)))
