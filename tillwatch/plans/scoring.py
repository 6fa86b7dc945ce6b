"""Rules, hybrid score, cost-based threshold and the investigation queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.config import KEY, LABEL, MONTH, SWEEP_STEPS, RuleBook, SweepCosts
from tillwatch.functions.columns import skip_nan
from tillwatch.functions.rules import hybrid_score, rule_reason, rule_score


def with_rules(scored: DataFrame, book: RuleBook = RuleBook()) -> DataFrame:
    return scored.withColumns({"rule_score": rule_score(book), "rule_reason": rule_reason(book)})


def with_hybrid(scored: DataFrame, model: str = "challenger_score") -> DataFrame:
    return scored.withColumn("final_risk_score", hybrid_score(F.col(model), F.col("rule_score")))


def cut_value(index: Column, steps: int = SWEEP_STEPS) -> Column:
    """The ``index``-th of ``steps`` evenly spaced cuts: index times the step width, the last exactly 1."""
    return F.when(index == steps - 1, F.lit(1.0)).otherwise(index.cast("double") * F.lit(1.0 / (steps - 1)))


def cuts_reached(score: Column, steps: int = SWEEP_STEPS) -> Column:
    """Number of cuts at or below the score, by comparison with the cuts themselves.

    The division only gives a first guess; rounding may put it one off next to a cut.
    """
    known = skip_nan(score.cast("double"))
    bounded = F.greatest(F.least(known, F.lit(1.0)), F.lit(0.0))
    guess = F.floor(bounded * (steps - 1)).cast("int")
    return (
        F.when(known.isNull() | (known < 0), 0)
        .when(cut_value(guess, steps) > known, guess)
        .when((guess < steps - 1) & (cut_value(guess + 1, steps) <= known), guess + 2)
        .otherwise(guess + 1)
    )


def threshold_sweep(
    scored: DataFrame,
    steps: int = SWEEP_STEPS,
    costs: SweepCosts = SweepCosts(),
    score: str = "final_risk_score",
    label: str = LABEL,
) -> DataFrame:
    """``(threshold, tp, fp, fn, profit)`` for every cut, from one pass over the scores.

    Rows are counted by the number of cuts they reach, at most ``steps`` + 1 groups, and only these groups meet the
    cuts.
    """
    groups = scored.groupBy(cuts_reached(F.col(score), steps).alias("reached")).agg(
        F.count_if(F.col(label) == 1).alias("bad"), F.count_if(F.col(label) == 0).alias("good")
    )
    cut = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    alert = F.col("cut") < F.col("reached")

    def total(condition, column):
        return F.sum(F.when(condition, F.col(column)).otherwise(F.lit(0)))

    return (
        groups.withColumn("cut", cut)
        .groupBy("cut")
        .agg(total(alert, "bad").alias("tp"), total(alert, "good").alias("fp"), total(~alert, "bad").alias("fn"))
        .select(cut_value(F.col("cut"), steps).alias("threshold"), "tp", "fp", "fn", _profit(costs).alias("profit"))
    )


def _profit(costs: SweepCosts) -> Column:
    return (
        F.col("tp") * costs.true_positive - F.col("fp") * costs.false_positive - F.col("fn") * costs.false_negative
    )


def optimal_threshold(sweep: DataFrame) -> DataFrame:
    """The cut of highest profit, the lowest one on ties."""
    return sweep.select("threshold", "profit").orderBy(F.col("profit").desc(), "threshold").limit(1)


def with_alerts(scored: DataFrame, threshold: float | Column, score: str = "final_risk_score") -> DataFrame:
    """Adds the 0/1 flag; ``threshold`` is a number or the scalar of a one-row frame."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return scored.withColumn("alert_flag", F.when(skip_nan(F.col(score)) >= limit, 1).otherwise(0))


def score_portfolio(
    scored: DataFrame,
    book: RuleBook = RuleBook(),
    costs: SweepCosts = SweepCosts(),
    steps: int = SWEEP_STEPS,
    model: str = "challenger_score",
) -> DataFrame:
    """Model scores to the final table: rules, hybrid score, best threshold on this table, alert flag."""
    hybrid = with_hybrid(with_rules(scored, book), model)
    best = optimal_threshold(threshold_sweep(hybrid, steps, costs)).select("threshold").scalar()
    return with_alerts(hybrid, best)


def alert_metrics(portfolio: DataFrame) -> DataFrame:
    """Merchants, alerts and their rate, defaults caught and their share, in one pass."""
    caught = F.count_if((F.col("alert_flag") == 1) & (F.col(LABEL) == 1))
    return portfolio.agg(
        F.countDistinct(KEY).alias("merchants_scored"),
        F.count_if(F.col("alert_flag") == 1).alias("alerts"),
        F.avg("alert_flag").alias("alert_rate"),
        caught.alias("defaults_captured"),
        F.try_divide(caught.cast("double"), F.count_if(F.col(LABEL) == 1).cast("double")).alias("recall"),
    )


def investigation_queue(portfolio: DataFrame) -> DataFrame:
    """Alerts, highest score first."""
    return portfolio.where(F.col("alert_flag") == 1).orderBy(F.col("final_risk_score").desc(), KEY, MONTH)


def queue_top(portfolio: DataFrame, n: int = 5) -> DataFrame:
    """First rows of the queue with the columns an analyst reads."""
    return investigation_queue(portfolio).limit(n).select(KEY, "final_risk_score", "rule_reason", LABEL)


def cost_report(portfolio: DataFrame, costs: SweepCosts = SweepCosts()) -> DataFrame:
    """Hits and misses at the flag, and what they cost."""
    flag, bad = F.col("alert_flag"), F.col(LABEL)
    return portfolio.agg(
        F.count_if((flag == 1) & (bad == 1)).alias("tp"),
        F.count_if((flag == 1) & (bad == 0)).alias("fp"),
        F.count_if((flag == 0) & (bad == 1)).alias("fn"),
    ).select(
        "tp",
        "fp",
        "fn",
        (F.col("fn") * costs.false_negative).alias("missed_cost"),
        (F.col("fp") * costs.false_positive).alias("review_cost"),
        _profit(costs).alias("net_benefit"),
    )


# Score columns, the first one present is used.
SCORE_CANDIDATES = ("risk_score", "challenger_score", "score")


def top_by_score(portfolio: DataFrame, n: int = 10, candidates: tuple[str, ...] = SCORE_CANDIDATES) -> DataFrame:
    """The ``n`` highest rows by the first available score column."""
    present = [c for c in candidates if c in portfolio.columns]
    if not present:
        raise ValueError(f"none of {candidates} is a column")
    return (
        portfolio.select(KEY, MONTH, F.col(present[0]).alias("score"))
        .orderBy(F.col("score").desc_nulls_last(), KEY, MONTH)
        .limit(n)
    )
