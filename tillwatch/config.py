"""Parameters of the feature, label and scoring definitions."""

from __future__ import annotations

from calendar import monthrange
from dataclasses import dataclass
from datetime import date, timedelta

KEY = "merchant_id"
MONTH = "month_end"
LABEL = "default_next_60d"
# Partition column of the stored payments: first day of the month of the timestamp.
MONTH_PARTITION = "txn_month"


# First and last day of a range, either may be open.
Days = tuple[date | None, date | None]


@dataclass(frozen=True)
class Spine:
    """Reporting months, given by the first day of the first and of the last month."""

    first: date = date(2025, 1, 1)
    last: date = date(2025, 12, 1)

    @property
    def first_end(self) -> date:
        return self.first.replace(day=monthrange(self.first.year, self.first.month)[1])

    @property
    def last_end(self) -> date:
        return self.last.replace(day=monthrange(self.last.year, self.last.month)[1])

    def tail(self) -> "Spine":
        """The last month and the one before; history older than that counts into the first of them."""
        before = (self.last - timedelta(days=1)).replace(day=1)
        return Spine(max(self.first, before), self.last)

    def past(self, width: int) -> Days:
        """First and last day that any backward window of ``width`` days can hold."""
        return self.first_end - timedelta(days=width - 1), self.last_end

    def ahead(self, width: int) -> Days:
        """First and last day that any forward window of ``width`` days can hold."""
        return self.first_end + timedelta(days=1), self.last_end + timedelta(days=width)

    def history(self, ahead: int = 0) -> Days:
        """Everything up to ``ahead`` days after the last month end."""
        return None, self.last_end + timedelta(days=ahead)


@dataclass(frozen=True)
class LabelRule:
    """Thresholds of the default label; any one clause is enough."""

    chargeback: float = 0.06
    fraud: float = 0.06
    decline: float = 0.25
    fraud_count: int = 10
    sla: float = 0.20
    txn_count: int = 200


@dataclass(frozen=True)
class RuleBook:
    """Thresholds of the hard risk rules."""

    chargeback_rate: float = 0.01
    gmv: float = 1000.0
    sla_breach_rate: float = 0.08
    fraud_rate: float = 0.015
    txn_count: int = 100


@dataclass(frozen=True)
class SweepCosts:
    """Pay-off of one caught default, one needless review and one missed default."""

    true_positive: int = 2
    false_positive: int = 1
    false_negative: int = 10


# Score cuts tried by the threshold search, 0 to 1 in equal steps.
SWEEP_STEPS = 100

# Label thresholds tried when calibrating the default rate.
GRID_CHARGEBACK = (0.02, 0.03, 0.04, 0.05, 0.06)
GRID_FRAUD = (0.03, 0.04, 0.05, 0.06, 0.08)
GRID_KEEP = (0.02, 0.04)

# Model inputs.
MODEL_FEATURES = (
    "txn_count_30d",
    "gmv_30d",
    "decline_rate_30d",
    "fraud_rate_30d",
    "chargeback_rate_30d",
    "sla_events_60d",
    "sla_breach_rate_60d",
    "fraud_rate_60d",
    "chargeback_rate_60d",
    "cumulative_fraud_90d",
    "fraud_acceleration",
    "chargeback_acceleration",
    "amount_volatility_90d",
    "rolling_max_decline_spike",
    "z_score_fraud",
    "decline_rate_90d",
    "risk_interaction",
    "decline_x_fraud",
)

# Features looked at in the exploratory report.
REPORT_FEATURES = (
    "fraud_rate_30d",
    "chargeback_rate_30d",
    "decline_rate_30d",
    "sla_breach_rate_60d",
    "z_score_fraud",
    "risk_interaction",
)
