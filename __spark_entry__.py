"""Entry points: the flagship query, every query by name, and the SQL each is checked against."""

from __future__ import annotations

import sys
from collections.abc import Callable
from datetime import date
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import oracle
from tillwatch.config import LABEL, MODEL_FEATURES, LabelRule, Spine
from tillwatch.functions.rules import linear_score
from tillwatch.operators.rollup import daily_activity, daily_declines
from tillwatch.operators.spine import month_spine, month_spine_ends
from tillwatch.plans import allocation, eda, features, labels, marts, metrics, models, quality, scoring, training_set
from tillwatch.session import hand_off, shared_folder
from tillwatch.sources import files, schemas
from tillwatch.sources import stand_in as fx
from tillwatch.sources.stand_in import StandIn
from tillwatch.sources.views import register_views

ON = ["merchant_id", "month_end"]
SCORES = {"champion": "champ_score", "challenger": "challenger_score"}
Query = Callable[[SparkSession, str], DataFrame]

try:  # the package for document tables, or a library that only it needs, may be missing
    from tillwatch.llm import queries as corpus
except ImportError:
    corpus = None


def six_decimals(df: DataFrame) -> DataFrame:
    """Decimals as doubles and doubles at six decimals (without negative zero), for comparison with other engines."""
    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.DecimalType)):
            out.append((F.round(F.col(field.name).cast("double"), 6) + F.lit(0.0)).alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


class Tables:
    """The stand-in tables of a directory and what the queries derive from them.

    Stages that the batch runs write out between steps (training frame, scored test months, models) are written once
    per session and directory; everything else stays lazy.
    """

    _made: dict[tuple, object] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.raw = self._once("raw", lambda: StandIn(spark, folder))
        self.merchants, self.txns, self.sla = self.raw.merchants, self.raw.transactions, self.raw.sla_events

    def _once(self, name: str, make: Callable[[], object]):
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in self._made:
            self._made[key] = make()
        return self._made[key]

    def spine(self) -> DataFrame:
        return month_spine(self.merchants, fx.SPINE)

    def daily(self) -> DataFrame:
        """The day rollup that features and labels share."""
        return self._once("daily", lambda: hand_off(daily_activity(self.txns, self.sla), "daily"))

    def features(
        self, daily: DataFrame | None = None, percentile: bool = True, spine: Spine = fx.SPINE, label: LabelRule | None = None
    ) -> DataFrame:
        return features.merchant_month_features(
            self.txns, self.sla, self.merchants, spine, daily=daily, percentile=percentile, label=label
        )

    def rates(self, daily: DataFrame | None = None, spine: Spine = fx.SPINE) -> DataFrame:
        return labels.forward_rates(self.txns, self.sla, self.merchants, spine, daily=daily)

    def rates_corrected(self) -> DataFrame:
        return labels.forward_rates(self.txns, self.sla, self.merchants, fx.SPINE, as_written=False, clock="ts")

    def outcomes(self) -> DataFrame:
        return labels.outcomes_monthly(labels.default_label(self.rates(self.daily()), fx.LABEL_RULE))

    def outcomes_stored(self) -> DataFrame:
        """The label table as written by month and read back."""
        path = _new_path(self.spark)
        labels.write_outcomes(labels.default_label(self.rates(), fx.LABEL_RULE), path)
        stored = self.spark.read.parquet(path)
        return stored.select(*ON, LABEL)

    def queue(self) -> DataFrame:
        """The latest month: two months of features, one of labels."""
        tail = fx.SPINE.tail()
        labelled = labels.default_label(self.rates(self.daily(), Spine(tail.last, tail.last)), fx.LABEL_RULE)
        wide = self.features(self.daily(), percentile=False, spine=tail)
        return marts.risk_queue_mart(tail, wide, labels.outcomes_monthly(labelled))

    def training_lazy(self, as_written: bool = False) -> DataFrame:
        return training_set.training_frame(
            self.txns, self.sla, self.merchants, fx.SPINE, fx.LABEL_RULE, as_written, self.daily_instant()
        )

    def daily_instant(self) -> DataFrame:
        return self._once(
            "daily-instant", lambda: hand_off(daily_activity(self.txns, self.sla, clock="ts"), "daily-instant")
        )

    def training(self) -> DataFrame:
        return self._once("training", lambda: hand_off(self.training_lazy(), "training"))

    def split(self) -> DataFrame:
        return marts.oot_split(self.training(), cut=fx.CUT, spine=fx.SPINE)

    def train(self) -> DataFrame:
        return marts.train_part(self.split())

    def test(self) -> DataFrame:
        return marts.test_part(self.split())

    def scored(self) -> DataFrame:
        """Test months with two fixed-coefficient scores, so that every later step can be checked exactly."""

        def make():
            scores = {n: linear_score(weights, intercept) for n, (intercept, weights) in oracle.COEFFICIENTS.items()}
            return hand_off(self.test().drop("split").withColumns(scores), "scored")

        return self._once("scored", make)

    def ruled(self) -> DataFrame:
        return scoring.with_rules(self.scored(), fx.RULE_BOOK)

    def hybrid(self) -> DataFrame:
        return scoring.with_hybrid(self.ruled())

    def sweep(self) -> DataFrame:
        return scoring.threshold_sweep(self.hybrid())

    def portfolio(self) -> DataFrame:
        return scoring.score_portfolio(self.scored(), fx.RULE_BOOK)

    def models(self) -> models.ModelPair:
        return models.ModelPair(self.champion(), self.challenger())

    def challenger(self):
        return self._once("challenger", lambda: models.train_challenger(self.train()))

    def champion(self):
        return self._once("champion", lambda: models.train_champion(self.train()))

    def model_scored(self) -> DataFrame:
        return self._once(
            "model-scored", lambda: hand_off(models.score_both(self.models(), self.train(), self.test()), "model-scored")
        )

    def agreement(self) -> DataFrame:
        """Whether the champion's stored score is the one that its coefficients give."""
        by_hand = models.champion_by_hand(self.champion(), self.train(), self.model_scored())
        close = F.abs(F.col("champ_score") - by_hand) < 1e-9
        return self.model_scored().select(*ON, LABEL, close.alias("agrees"))

    def constrained(self) -> dict[str, DataFrame]:
        return {
            "merchants": self.merchants,
            "transactions": self.txns,
            "sla_events": self.sla,
            "outcomes_monthly": self.outcomes(),
        }

    def exceptions(self) -> DataFrame:
        return quality.data_exceptions(self.txns, self.merchants, self._counts(), fx.AS_OF)

    def _counts(self) -> DataFrame:
        """The keys and counts of the feature table; the percentile is not computed for them."""
        return self.features(self.daily(), percentile=False).select(*ON, "txn_count_30d")


def _through_csv(df: DataFrame, schema: T.StructType, load: Callable) -> DataFrame:
    """Writes the table as CSV files in the shared folder and loads them with the typed reader."""
    spark = df.sparkSession
    text = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    path = _new_path(spark)
    files.write_scored(text, path, "csv")
    return load(spark, path)


def _new_path(spark: SparkSession) -> str:
    import uuid

    return f"{shared_folder(spark)}/tillwatch/{spark.sparkContext.applicationId}/csv-{uuid.uuid4().hex}"


def _csv_roundtrip(t: Tables) -> DataFrame:
    portfolio = t.portfolio()
    path = _new_path(t.spark)
    files.write_scored(portfolio, path, "csv")
    return files.read_scored(t.spark, path, portfolio.schema, "csv").select(*_PORTFOLIO)


def _watched_write(t: Tables) -> DataFrame:
    """Counts of both kinds from the one pass that writes the payments."""
    watch = quality.Watch("transactions", schemas.NOT_NULL["transactions"], schemas.DOMAINS["transactions"])
    files.save_transactions(t.txns, _new_path(t.spark), watch=watch.on)
    nulls = watch.null_rows(t.spark).toDF("table_name", "rule", "broken")
    return nulls.unionByName(watch.violations(t.spark).withColumnRenamed("violations", "broken"))


def _sql_views(t: Tables) -> DataFrame:
    register_views(t.merchants, t.txns, t.sla, fx.SPINE, fx.LABEL_RULE, as_of=fx.AS_OF)
    return t.spark.sql(
        """SELECT industry, count(*) AS rows_n, avg(default_next_60d) AS default_rate,
        avg(fraud_rate_30d) AS fraud_rate FROM v_model_dataset GROUP BY industry"""
    )


_PORTFOLIO = [
    *ON, "rule_reason", LABEL, "alert_flag", "champ_score", "challenger_score", "rule_score", "final_risk_score",
]
_WINDOW = [*training_set.WINDOW_COLUMNS]


def catalog() -> dict[str, Callable[[Tables], DataFrame]]:
    """The queries over payment tables, as functions of the tables of a directory."""
    f, lb, q, s = features, labels, quality, scoring
    return {
        # sources and sinks
        "src_merchants": lambda t: _through_csv(t.merchants, schemas.MERCHANTS, files.load_merchants),
        "src_transactions": lambda t: _through_csv(t.txns, schemas.TRANSACTIONS, files.load_transactions),
        "src_sla_events": lambda t: _through_csv(t.sla, schemas.SLA_EVENTS, files.load_sla_events),
        "csv_roundtrip": _csv_roundtrip,
        "sql_views": _sql_views,
        # month spines
        "month_spine": lambda t: t.spine(),
        "month_spine_ends": lambda t: month_spine_ends(t.merchants, fx.SPINE),
        # features over past windows
        "txn_features_30d": lambda t: f.txn_features_30d(t.txns, t.merchants, fx.SPINE),
        "p95_sketched": lambda t: f.sketched_percentile(f.daily_amount_sketches(t.txns, fx.SPINE.past(30)), fx.SPINE),
        "sla_features_60d": lambda t: f.sla_features_60d(t.sla, t.merchants, fx.SPINE),
        "txn_features_60d": lambda t: f.txn_features_60d(t.txns, t.merchants, fx.SPINE),
        "daily_declines": lambda t: daily_declines(t.txns),
        "txn_features_90d": lambda t: f.txn_features_90d(t.txns, t.merchants, fx.SPINE),
        "txn_features_90d_corrected": lambda t: f.txn_features_90d(t.txns, t.merchants, fx.SPINE, as_written=False),
        "historical_fraud": lambda t: f.historical_fraud(t.txns, t.merchants, fx.SPINE),
        "mom_trends": lambda t: f.mom_trends(f.txn_features_30d(t.txns, t.merchants, fx.SPINE, percentile=False)),
        "mom_lag": lambda t: t.training_lazy().select(
            *ON, "prev_fraud_rate", "prev_cb_rate", "fraud_acceleration", "chargeback_acceleration"
        ),
        "z_score_fraud": lambda t: t.features(percentile=False).select(*ON, "z_score_fraud"),
        "interactions": lambda t: t.features(percentile=False).select(*ON, "risk_interaction", "decline_x_fraud"),
        "merchant_month_features": lambda t: t.features(),
        "calendar_month_features": lambda t: training_set.calendar_month_features(t.txns),
        "calendar_month_features_as_written": lambda t: training_set.calendar_month_features(t.txns, True),
        "calendar_month_sla": lambda t: training_set.calendar_month_sla(t.sla),
        "calendar_month_sla_as_written": lambda t: training_set.calendar_month_sla(t.sla, True),
        "ts_window_features": lambda t: training_set.ts_window_features(t.txns, t.merchants, fx.SPINE),
        "impute_zero": lambda t: training_set.fill_zero(
            training_set.ts_window_features(t.txns, t.merchants, fx.SPINE), _WINDOW
        ),
        # forward labels
        "forward_rates_60d": lambda t: t.rates(),
        "default_label": lambda t: lb.default_label(t.rates(), fx.LABEL_RULE).select(*ON, LABEL),
        "default_label_corrected": lambda t: lb.default_label(t.rates_corrected(), fx.LABEL_RULE),
        "label_condition_rates": lambda t: lb.label_condition_rates(t.rates_corrected()),
        "threshold_grid": lambda t: lb.threshold_grid(t.rates_corrected(), fx.GRID_CHARGEBACK, fx.GRID_FRAUD),
        "outcomes_monthly": lambda t: t.outcomes_stored(),
        # dataset, reports, split
        "model_dataset": lambda t: t.features(t.daily(), label=fx.LABEL_RULE),
        "mart_portfolio_overview": lambda t: marts.portfolio_overview(
            t.spine(), t.features(t.daily(), percentile=False), t.outcomes()
        ),
        "mart_risk_queue": lambda t: t.queue(),
        "python_master": lambda t: t.training_lazy(),
        "python_master_as_written": lambda t: t.training_lazy(True),
        "oot_split": lambda t: t.split().select(*ON, "split", "month", LABEL),
        # data quality
        "dq_orphan_txn": lambda t: q.orphan_transactions(t.txns, t.merchants).select("txn_id", "merchant_id"),
        "dq_neg_amount": lambda t: q.non_positive_amounts(t.txns).select("txn_id", "amount"),
        "dq_future_ts": lambda t: q.future_timestamps(t.txns, fx.AS_OF).select("txn_id", "txn_ts"),
        "dq_dup_txn_id": lambda t: q.duplicate_ids(t.txns),
        "dq_leakage_guard": lambda t: q.leakage_guard(t._counts(), t.txns),
        "dq_leakage_corrected": lambda t: q.leakage_check(t.txns, t.sla, t.merchants, fx.SPINE),
        "data_exceptions": lambda t: t.exceptions(),
        "dq_summary": lambda t: q.exception_summary(t.exceptions()),
        "label_sanity": lambda t: q.label_sanity(t.outcomes(), t.merchants),
        "ck_primary_key": lambda t: q.check_primary_keys(t.constrained(), schemas.PRIMARY_KEYS),
        "ck_foreign_key": lambda t: q.check_foreign_keys(t.constrained(), t.merchants, schemas.FOREIGN_KEYS),
        "ck_not_null": lambda t: q.check_not_null(t.constrained(), schemas.NOT_NULL),
        "ck_domain": lambda t: q.check_domains(t.constrained(), schemas.DOMAINS),
        "ck_while_writing": _watched_write,
        # models and metrics
        "standardize": lambda t: models.standardize(t.train(), t.training()).select(*ON, *MODEL_FEATURES),
        "class_weights": lambda t: models.class_weights(t.train()),
        "champion_lr": lambda t: models.coefficients(t.champion(), t.training()),
        "challenger_gbt": lambda t: t.model_scored().select(*ON, LABEL, "challenger_score"),
        "feature_importance": lambda t: models.feature_importance(t.models(), t.training()),
        "score_both": lambda t: t.model_scored().select(*ON, LABEL, "champ_score", "challenger_score"),
        "linear_score": lambda t: t.scored().select(*ON, "champ_score", "challenger_score"),
        "pr_auc": lambda t: metrics.pr_auc(t.scored(), "challenger_score"),
        "roc_auc": lambda t: metrics.roc_auc(t.scored(), "challenger_score"),
        "precision_at_k": lambda t: metrics.precision_at(t.scored(), "challenger_score"),
        "pr_curve_points": lambda t: metrics.pr_curves(t.scored(), SCORES),
        "pr_curve_thinned": lambda t: metrics.thinned_pr_curve(t.scored(), "challenger_score", cells=64),
        "model_comparison": lambda t: metrics.model_comparison(t.scored(), SCORES),
        "model_comparison_fitted": lambda t: metrics.model_comparison(t.model_scored(), SCORES),
        # what can be said about the fits without their numbers
        "champion_lr_gradient": lambda t: models.champion_gradient(t.champion(), t.train()).select(
            "feature", (F.round("gradient", 4) + F.lit(0.0)).alias("gradient")
        ),
        "score_both_agreement": lambda t: t.agreement(),
        "challenger_gbt_range": lambda t: t.model_scored().select(
            *ON, LABEL, F.col("challenger_score").between(0, 1).alias("in_range")
        ),
        "challenger_first_tree": lambda t: models.challenger_nodes(t.challenger(), t.training(), rounds=1).drop("tree"),
        "challenger_first_scores": lambda t: models.first_round_scores(t.challenger(), t.test()).select(*ON, "first_score"),
        "feature_importance_total": lambda t: models.feature_importance(t.models(), t.training()).agg(
            F.count_if(F.col("importance") >= 0).alias("features"), F.sum("importance").alias("total")
        ),
        # rules, threshold, queue
        "rule_score": lambda t: t.ruled().select(*ON, "rule_score"),
        "rule_reason": lambda t: t.ruled().select(*ON, "rule_reason"),
        "hybrid_score": lambda t: t.hybrid().select(*ON, "challenger_score", "rule_score", "final_risk_score"),
        "threshold_sweep": lambda t: t.sweep(),
        "optimal_threshold": lambda t: s.optimal_threshold(t.sweep()),
        "alert_flag": lambda t: t.portfolio().select(*ON, "final_risk_score", "alert_flag"),
        "alert_metrics": lambda t: s.alert_metrics(t.portfolio()),
        "investigation_queue": lambda t: s.investigation_queue(t.portfolio()).select(*_PORTFOLIO),
        "queue_top5": lambda t: s.queue_top(t.portfolio()),
        "final_scored_portfolio": lambda t: t.portfolio(),
        "cost_tradeoff": lambda t: s.cost_report(t.portfolio()),
        "top10_by_score": lambda t: s.top_by_score(t.portfolio()),
        # exploratory reports
        "eda_default_by_industry": lambda t: eda.rate_by(t.scored(), "industry"),
        "eda_default_by_tier": lambda t: eda.rate_by_tier(t.scored(), t.merchants),
        "eda_histograms": lambda t: eda.histograms(t.scored()),
        "eda_class_balance": lambda t: eda.class_balance(t.scored()),
        "eda_correlations": lambda t: eda.correlations(t.scored()),
        "proportional_allocation": lambda t: allocation.proportional_allocation(
            t.merchants, 60_000, date(2000, 1, 1), date(2000, 12, 30)
        ).select("merchant_id", "txn_count"),
    }


def queries() -> dict[str, Query]:
    """One entry per operator; each callable takes ``(spark, folder)`` and returns a DataFrame."""

    def bind(make: Callable[[Tables], DataFrame]) -> Query:
        return lambda spark, folder: six_decimals(make(Tables(spark, folder)))

    return {name: bind(make) for name, make in catalog().items()} | (corpus.QUERIES if corpus else {})


def oracle_sql() -> dict[str, str]:
    """SQL over the raw tables for every query that SQL can express; model fits have none."""
    return oracle.build() | (corpus.SQL if corpus else {})


def entry(spark: SparkSession) -> DataFrame:
    """Portfolio report per month: features, labels and the join of both, from the raw tables."""
    return queries()["mart_portfolio_overview"](spark, "/root/testdata/sf0.001")
