"""Every stage as a temporary view, to be queried in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillwatch.config import LabelRule, Spine
from tillwatch.operators.rollup import daily_declines
from tillwatch.operators.spine import month_spine
from tillwatch.plans import features as f
from tillwatch.plans import labels as lb
from tillwatch.plans import marts, quality


def register_views(
    merchants: DataFrame,
    transactions: DataFrame,
    sla_events: DataFrame,
    spine: Spine = Spine(),
    rule: LabelRule = LabelRule(),
    outcomes: DataFrame | None = None,
    as_of: str | None = None,
) -> list[str]:
    """Registers the tables and all derived views; nothing is computed yet.

    ``outcomes`` is the written label table; without it the label view takes its place. ``v_data_exceptions`` counts
    equal exceptions in ``occurrences``; ``quality.expand_occurrences`` repeats the rows of a part of it. The wide table
    and the dataset keep the percentile, as a user may ask for any of their columns.
    """
    features_30d = f.txn_features_30d(transactions, merchants, spine)
    table = f.merchant_month_features(transactions, sla_events, merchants, spine)
    labels = lb.default_label(lb.forward_rates(transactions, sla_events, merchants, spine), rule)
    # without a written label table, features and label come from one aggregation instead of two and a join
    dataset = (
        f.merchant_month_features(transactions, sla_events, merchants, spine, label=rule)
        if outcomes is None
        else marts.model_dataset(table, outcomes)
    )
    outcomes = lb.outcomes_monthly(labels) if outcomes is None else outcomes
    months = month_spine(merchants, spine)
    # reports read no percentile, and a plan can't drop it from the wide table by itself
    slim = f.merchant_month_features(transactions, sla_events, merchants, spine, percentile=False)
    exceptions = quality.data_exceptions(transactions, merchants, slim, as_of)
    views = {
        "merchants": merchants,
        "transactions": transactions,
        "sla_events": sla_events,
        "outcomes_monthly": outcomes,
        "v_merchant_months": months,
        "v_txn_features_past_30d": features_30d,
        "v_sla_features_past_60d": f.sla_features_60d(sla_events, merchants, spine),
        "v_txn_features_past_60d": f.txn_features_60d(transactions, merchants, spine),
        "v_txn_trends_mom": f.mom_trends(f.txn_features_30d(transactions, merchants, spine, percentile=False)),
        "v_daily_declines": daily_declines(transactions),
        "v_txn_features_past_90d": f.txn_features_90d(transactions, merchants, spine),
        "v_merchant_historical_fraud": f.historical_fraud(transactions, merchants, spine),
        "v_merchant_month_features": table,
        "v_default_label_next_60d": labels,
        "v_data_exceptions": exceptions,
        "v_label_sanity": quality.label_sanity(outcomes, merchants),
        "v_model_dataset": dataset,
        "v_mart_portfolio_overview": marts.portfolio_overview(months, slim, outcomes),
        "v_mart_merchant_risk_queue": marts.risk_queue_mart(spine, slim, outcomes),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
