"""Exact ranking metrics on score tables of any size; ties are one point of the curve."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.config import KEY, LABEL, MONTH
from tillwatch.operators.ranking import BUCKETS, running_totals


def _cuts(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score: positives and rows at it, and from the highest score down to it."""
    return running_totals(
        scored,
        score,
        {"positives": F.sum(F.col(label).cast("bigint")), "rows": F.count(F.lit(1))},
    )


def scored_rows(frame: DataFrame, score: str) -> DataFrame:
    """Rows that have a score: curves, areas and precision are all taken over these alone."""
    return frame.where(F.col(score).isNotNull())


def unscored(frame: DataFrame, scores: dict[str, str]) -> DataFrame:
    """``(model, unscored)``: how many rows the metrics of each model leave out."""
    counts = [F.struct(F.lit(m).alias("model"), F.count_if(F.col(c).isNull()).alias("unscored")) for m, c in scores.items()]
    return frame.agg(F.array(*counts).alias("counts")).select(F.inline("counts"))


def pr_curve(scored: DataFrame, score: str, label: str = LABEL) -> DataFrame:
    """``(threshold, precision, recall)`` per distinct score, plus the end point recall 0, precision 1."""
    points = _points(scored, score, label)
    end = points.agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def _points(scored: DataFrame, score: str, label: str) -> DataFrame:
    return _cuts(scored, score, label).select(
        F.col(score).cast("double").alias("threshold"),
        (F.col("cum_positives") / F.col("cum_rows")).alias("precision"),
        F.try_divide(F.col("cum_positives").cast("double"), F.col("all_positives").cast("double")).alias("recall"),
    )


def thinned_pr_curve(scored: DataFrame, score: str, cells: int = 256, label: str = LABEL) -> DataFrame:
    """At most ``4 * (cells + 1)`` points of ``pr_curve`` and its end point, whatever the number of scores.

    ``(cell, threshold, precision, recall, slack)``. Recall is cut into equal cells; of each cell stay the first and the
    last point along the curve and those of least and highest precision (ties: the highest threshold). So

    * a dropped point is at most a cell's width in recall from the thinned curve, which passes its precision inside the cell;
    * inside a cell both curves join the same two points in the same box, whose area is ``slack``, the same on all points
      of the cell; between cells they are the same line. The areas under both differ by at most the sum of the cells' slacks.

    Points are grouped by cell where the running totals left them: one small aggregation, and no further sort. Without
    any positive there is no recall, and one cell NULL; the end point has the cell -1.
    """
    def first_by(pick, *order):
        return pick(F.struct("threshold", "precision", "recall"), F.struct(*order))

    falling = (-F.col("threshold")).alias("falling")
    extremes = _points(scored, score, label).groupBy(F.floor(F.col("recall") * cells).cast("int").alias("cell")).agg(
        F.array_distinct(
            F.array(
                first_by(F.max_by, "threshold"), first_by(F.min_by, "threshold"),
                first_by(F.min_by, "precision", falling), first_by(F.max_by, "precision", "threshold"),
            )
        ).alias("points"),
        ((F.max("recall") - F.min("recall")) * (F.max("precision") - F.min("precision"))).alias("slack"),
    )
    kept = extremes.select("cell", F.inline("points"), "slack")
    end = extremes.agg(
        F.lit(-1).alias("cell"), F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"), F.lit(0.0).alias("slack"),
    )
    return kept.unionByName(end)


def pr_curves(scored: DataFrame, scores: dict[str, str], label: str = LABEL) -> DataFrame:
    """Curves of several models, ``{model name: score column}``, stacked."""
    parts = [pr_curve(scored, column, label).select(F.lit(m).alias("model"), "*") for m, column in scores.items()]
    return reduce(DataFrame.unionByName, parts)


def areas(scored: DataFrame, score: str, label: str = LABEL) -> DataFrame:
    """One row ``(pr_auc, roc_auc)``: trapezoids under both curves, from the same pass over the cuts.

    The precision-recall curve starts at recall 0 with precision 1. NULL where one class is missing.
    """
    tp, n = F.col("cum_positives").cast("double"), F.col("cum_rows").cast("double")
    tp0, n0 = tp - F.col("positives"), n - F.col("rows")
    precision, before = tp / n, F.when(n0 > 0, F.try_divide(tp0, n0)).otherwise(F.lit(1.0))
    pr = F.sum((tp - tp0) * (precision + before) / 2.0)
    roc = F.sum(((n - tp) - (n0 - tp0)) * (tp + tp0) / 2.0)
    positives, rows = F.sum("positives").cast("double"), F.sum("rows").cast("double")
    return _cuts(scored, score, label).agg(
        F.try_divide(pr, positives).alias("pr_auc"),
        F.try_divide(roc, positives * (rows - positives)).alias("roc_auc"),
    )


def pr_auc(scored: DataFrame, score: str, label: str = LABEL) -> DataFrame:
    return areas(scored, score, label).select("pr_auc")


def roc_auc(scored: DataFrame, score: str, label: str = LABEL) -> DataFrame:
    return areas(scored, score, label).select("roc_auc")


def precision_at(
    scored: DataFrame,
    score: str,
    share: float = 0.05,
    label: str = LABEL,
    key: str = KEY,
    month: str = MONTH,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row ``(k, precision_at_k)``: mean label of the ``k = int(share * n)`` highest scores.

    Rows without a score count neither in ``n`` nor in the top. Equal scores rank by key, then month, then label; a NaN
    is above all numbers. ``k`` grows with the data, so the top is never sorted out or collected: running totals over
    that whole order are taken in buckets, and the one place where they reach ``k`` gives the positives down to it. A
    score shared by a third of all rows is as many places as it has keys. ``n`` comes with the totals.
    """
    labelled = scored_rows(scored, score).select(
        F.col(score).cast("double").alias("score"), key, month, F.coalesce(F.col(label).cast("bigint"), F.lit(0)).alias("hit")
    )
    falling = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(-F.col("score")).alias("falling")
    places = labelled.select(F.struct(falling, key, month, "hit").alias("place"), "hit")
    totals = {"positives": F.sum("hit"), "rows": F.count(F.lit(1))}
    running = running_totals(places, "place", totals, descending=False, buckets=buckets)
    k = F.floor(F.col("all_rows") * F.lit(float(share))).cast("bigint").alias("k")
    # rows alike in everything are one place, of which only the first may be wanted
    wanted = F.col("k") - (F.col("cum_rows") - F.col("rows"))
    hits = F.col("cum_positives") - F.col("positives") + wanted * F.col("place.hit")
    reaching = F.when(F.col("cum_rows") >= F.col("k"), F.col("cum_rows"))
    top = running.select("*", k).agg(
        F.coalesce(F.max("k"), F.lit(0).cast("bigint")).alias("k"), F.min_by(hits, reaching).alias("hits")
    )
    precision = F.when(F.col("k") > 0, F.try_divide(F.col("hits").cast("double"), F.col("k").cast("double")))
    return top.select("k", precision.alias("precision_at_k"))


def model_comparison(scored: DataFrame, scores: dict[str, str], share: float = 0.05, label: str = LABEL) -> DataFrame:
    """One row per model: both areas and the precision at the top share."""
    rows = [
        areas(scored, column, label).select(
            F.lit(model).alias("model"),
            "pr_auc",
            "roc_auc",
            precision_at(scored, column, share, label).select("precision_at_k").scalar().alias("precision_at_k"),
        )
        for model, column in scores.items()
    ]
    return reduce(DataFrame.unionByName, rows)
