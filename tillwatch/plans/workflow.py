"""The three batch runs end to end, with written hand-offs between the stages."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.config import KEY, MONTH, LabelRule, RuleBook, Spine, SweepCosts
from tillwatch.operators.rollup import daily_activity
from tillwatch.operators.spine import month_spine
from tillwatch.plans import marts, metrics, models, scoring
from tillwatch.plans.features import merchant_month_features
from tillwatch.plans.labels import default_label, forward_rates, outcomes_monthly
from tillwatch.plans.training_set import training_frame
from tillwatch.session import HandOffs, hand_off
from tillwatch.sources import files

#: days that a label looks ahead
AHEAD = 60
SCORES = {"champion": "champ_score", "challenger": "challenger_score"}


def _by_month(df: DataFrame, out: str | None, name: str, mode: str = "errorifexists", only_months: bool = False) -> DataFrame:
    """A named table in ``out``, a folder for each month end, read back; without ``out``, a hand-off.

    ``only_months``: only the folders of months that ``df`` has rows of are replaced.
    """
    if out is None:
        return hand_off(df, name)
    path = f"{out}/{name}"
    writer = df.hint("rebalance", MONTH).write.mode(mode).partitionBy(MONTH)
    writer.option("partitionOverwriteMode", "dynamic" if only_months else "static").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def _scored(df: DataFrame, out: str | None, name: str) -> DataFrame:
    if out is None:
        return hand_off(df, name)
    files.write_scored(df, f"{out}/{name}")
    return files.read_scored(df.sparkSession, f"{out}/{name}", df.schema)


@dataclass(frozen=True)
class WarehouseTables:
    features: DataFrame
    outcomes: DataFrame
    dataset: DataFrame
    overview: DataFrame
    queue: DataFrame


def build_warehouse(
    merchants: DataFrame,
    txns: DataFrame,
    sla: DataFrame,
    spine: Spine = Spine(),
    rule: LabelRule = LabelRule(),
    out: str | None = None,
    mode: str = "errorifexists",
) -> WarehouseTables:
    """Features, labels, dataset and reports. The raw events are read for one rollup and once for the percentile.

    ``mode`` says what happens to tables that are there already: ``overwrite`` builds them anew. With ``out``, payments (by month), features and outcomes (by month end) are tables of that folder; the rollup is
    removed when they are written.
    """
    with HandOffs() as stages:
        # in the order of days, so that bounds on days skip row groups
        rollup = daily_activity(txns, sla).repartitionByRange("day").sortWithinPartitions("day", KEY)
        daily = stages.write(rollup, "daily")
        table = merchant_month_features(txns, sla, merchants, spine, daily=daily)
        features = _by_month(table, out, "merchant_month_features", mode)
        labels = default_label(forward_rates(None, None, merchants, spine, daily=daily), rule)
        outcomes = _by_month(outcomes_monthly(labels), out, "outcomes_monthly", mode)
    if out is not None:
        files.save_transactions(txns, f"{out}/transactions", mode)
    months = month_spine(merchants, spine)
    return WarehouseTables(
        features,
        outcomes,
        marts.model_dataset(features, outcomes),
        marts.portfolio_overview(months, features, outcomes),
        marts.risk_queue_mart(spine, features, outcomes),
    )


def months_of_events(spine: Spine, first_day: date, last_day: date, ahead: int = AHEAD) -> tuple[Spine | None, Spine | None]:
    """The months whose features, and those whose labels, can change with events of the days between.

    Features look back, and the history of a merchant back to its first day: all months from that of ``first_day`` on.
    Labels look ``ahead`` days forward from a month end: the ends from ``first_day - ahead`` to the day before ``last_day``.
    """

    def cut(first: date, last: date) -> Spine | None:
        first, last = max(first.replace(day=1), spine.first), min(last.replace(day=1), spine.last)
        return Spine(first, last) if first <= last else None

    before = last_day.replace(day=1) - timedelta(days=1)
    return cut(first_day, spine.last), cut(first_day - timedelta(days=ahead), before)


def refresh_warehouse(
    merchants: DataFrame,
    txns: DataFrame,
    sla: DataFrame,
    first_day: date,
    last_day: date,
    out: str,
    spine: Spine = Spine(),
    rule: LabelRule = LabelRule(),
) -> WarehouseTables:
    """The tables of ``out`` after events dated ``first_day`` to ``last_day`` came late, changed or went.

    ``txns`` and ``sla`` are the events as they are now. Only months that these days can change are computed and
    replaced, a folder each; the others are neither read nor written. Bounds on days reach the scan, so labels read no
    events outside the windows of their months. Running it twice gives the same tables.
    """
    of_features, of_labels = months_of_events(spine, first_day, last_day)
    spark = merchants.sparkSession
    if of_features:
        # changes against the month before need that month, which is not written
        before = max(spine.first, (of_features.first - timedelta(days=1)).replace(day=1))
        table = merchant_month_features(txns, sla, merchants, Spine(before, of_features.last))
        _by_month(table.where(F.col(MONTH) >= F.lit(of_features.first)), out, "merchant_month_features", "overwrite", True)
    if of_labels:
        labels = default_label(forward_rates(txns, sla, merchants, of_labels, width=AHEAD), rule)
        _by_month(outcomes_monthly(labels), out, "outcomes_monthly", "overwrite", True)
    features, outcomes = (spark.read.parquet(f"{out}/{name}") for name in ("merchant_month_features", "outcomes_monthly"))
    return WarehouseTables(
        features,
        outcomes,
        marts.model_dataset(features, outcomes),
        marts.portfolio_overview(month_spine(merchants, spine), features, outcomes),
        marts.risk_queue_mart(spine, features, outcomes),
    )


@dataclass(frozen=True)
class TrainingRun:
    models: models.ModelPair
    scored: DataFrame
    comparison: DataFrame


def run_training(
    merchants: DataFrame,
    txns: DataFrame,
    sla: DataFrame,
    spine: Spine = Spine(),
    rule: LabelRule = LabelRule(),
    last_train_month: int = 9,
    rounds: int = 100,
    cut: date | None = None,
    embargo_days: int = 0,
    out: str | None = None,
) -> TrainingRun:
    """Training frame, out-of-time split, both models, and the scored test months.

    A spine of several years needs ``cut``. With ``out``, the scored months are the table ``scored_test_set`` there.
    """
    with HandOffs() as stages:
        daily = stages.write(daily_activity(txns, sla, clock="ts"), "daily-instant")
        frame = stages.write(training_frame(txns, sla, merchants, spine, rule, daily=daily), "training")
        split = marts.oot_split(frame, last_train_month, cut, embargo_days, spine)
        train = marts.train_part(split)
        pair = models.train_models(train, rounds=rounds)
        scored = _scored(models.score_both(pair, train, marts.test_part(split)), out, "scored_test_set")
    return TrainingRun(pair, scored, metrics.model_comparison(scored, SCORES))


def run_scoring(
    scored: DataFrame, book: RuleBook = RuleBook(), costs: SweepCosts = SweepCosts(), out: str | None = None
) -> DataFrame:
    """The final scored table, written out; with ``out``, as ``final_scored_portfolio`` there."""
    return _scored(scoring.score_portfolio(scored, book, costs), out, "final_scored_portfolio")
