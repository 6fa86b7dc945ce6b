"""Champion (logistic regression, Spark ML) and challenger (second-order boosted trees), fitted on distributed rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.config import LABEL, MODEL_FEATURES
from tillwatch.functions.rules import resolved
from tillwatch.plans import boosting
from tillwatch.plans.boosting import BoostedTrees


def _statistics(columns: tuple[str, ...]) -> list[Column]:
    stats = [F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns]
    return stats + [F.stddev_pop(F.col(c).cast("double")).alias(f"sd_{c}") for c in columns]


def scaling(train: DataFrame, columns: tuple[str, ...] = MODEL_FEATURES) -> Column:
    """Means and population deviations of the training rows as one scalar struct, from one pass."""
    return train.agg(F.struct(*_statistics(columns)).alias("scaling")).scalar()


def _scaled(train: DataFrame, columns: tuple[str, ...]) -> dict[str, Column]:
    """Each column centred and scaled by numbers that are at hand.

    The assembler is a function of the JVM that is sent to tasks with its arguments' expressions, and a subquery among
    them would be sent with its plan, which can't be.
    """
    fitted = train.agg(*_statistics(columns)).first()
    sd = {c: fitted[f"sd_{c}"] for c in columns}
    return {
        c: (F.col(c).cast("double") - F.lit(fitted[f"mean_{c}"]).cast("double")) / F.lit(sd[c] if sd[c] and sd[c] > 0 else 1.0)
        for c in columns
    }


def standardize(train: DataFrame, frame: DataFrame, columns: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    """Centres and scales ``columns`` of ``frame`` by the training rows; a constant column is only centred."""
    fitted = scaling(train, columns)
    scaled = {}
    for c in columns:
        sd = fitted[f"sd_{c}"]
        scaled[c] = (F.col(c).cast("double") - fitted[f"mean_{c}"]) / F.when(sd > 0, sd).otherwise(F.lit(1.0))
    return frame.withColumns(scaled)


def class_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """``(label, n, balanced_weight, pos_weight)``; a class that is missing has no row, its weight no value."""
    positives = F.sum(F.col(label).cast("bigint")).alias("positives")
    total = train.agg(F.struct(F.count(label).alias("n"), positives)).scalar()
    pos_weight = F.try_divide((total["n"] - total["positives"]).cast("double"), total["positives"].cast("double"))
    return (
        train.where(F.col(label).isNotNull())
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            label,
            "n",
            (total["n"].cast("double") / (F.col("n") * 2.0)).alias("balanced_weight"),
            F.when(F.col(label) == 1, pos_weight).otherwise(F.lit(1.0)).alias("pos_weight"),
        )
    )


def _with_weight(train: DataFrame, weight: str, label: str) -> DataFrame:
    """Adds ``weight`` from the two-row weight table; the two numbers are all that the driver sees."""
    value = {r[label]: r[weight] for r in class_weights(train, label).collect()}
    if set(value) != {0, 1}:
        raise ValueError("training needs rows of both classes")
    return train.withColumn("weight", F.when(F.col(label) == 1, value[1]).otherwise(value[0]))


def _assembled(frame: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(frame)


def train_champion(
    train: DataFrame, columns: tuple[str, ...] = MODEL_FEATURES, label: str = LABEL, c: float = 1.0
) -> LogisticRegressionModel:
    """L2 logistic regression with balanced class weights on standardized features.

    The usual penalty is half the squared norm against ``c`` times the summed loss; Spark divides the loss by the sum
    of weights, which is the number of rows for balanced weights, hence ``regParam = 1 / (c * n)``.
    """
    rows = train.count()
    weighted = _with_weight(train, "balanced_weight", label).withColumns(_scaled(train, columns))
    model = LogisticRegression(
        featuresCol="features",
        labelCol=label,
        weightCol="weight",
        regParam=1.0 / (c * rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=500,
        tol=1e-12,
    )
    return model.fit(_assembled(weighted, columns).select("features", label, "weight"))


def train_challenger(
    train: DataFrame,
    columns: tuple[str, ...] = MODEL_FEATURES,
    label: str = LABEL,
    rounds: int = 100,
    step: float = 0.1,
    depth: int = 4,
) -> BoostedTrees:
    """Second-order boosted trees on raw features, positives weighted by negatives per positive."""
    return boosting.fit(_with_weight(train, "pos_weight", label), columns, label, "weight", rounds, step, depth)


@dataclass(frozen=True)
class ModelPair:
    champion: LogisticRegressionModel
    challenger: BoostedTrees
    columns: tuple[str, ...] = MODEL_FEATURES


def train_models(train: DataFrame, columns: tuple[str, ...] = MODEL_FEATURES, rounds: int = 100) -> ModelPair:
    return ModelPair(train_champion(train, columns), train_challenger(train, columns, rounds=rounds), columns)


def score_both(models: ModelPair, train: DataFrame, frame: DataFrame) -> DataFrame:
    """Adds ``champ_score`` and ``challenger_score``, at ``rules.SCORE_DIGITS``.

    The champion sees standardized features; they are assembled from expressions, so ``frame`` keeps its raw columns.
    """
    z = {f"z_{c}": column for c, column in _scaled(train, models.columns).items()}
    scaled = frame.withColumns(z)
    champion = models.champion.transform(_assembled(scaled, tuple(z)))
    champion = champion.withColumn("champ_score", resolved(vector_to_array("probability")[1]))
    champion = champion.drop("rawPrediction", "probability", "prediction", "features", *z)
    return champion.withColumn("challenger_score", resolved(models.challenger.score()))


def coefficients(
    champion: LogisticRegressionModel, frame: DataFrame, columns: tuple[str, ...] = MODEL_FEATURES
) -> DataFrame:
    """``(feature, coefficient)`` of the champion, with the intercept."""
    pairs = [(c, float(w)) for c, w in zip(columns, champion.coefficients)]
    pairs.append(("intercept", float(champion.intercept)))
    return frame.sparkSession.createDataFrame(pairs, "feature string, coefficient double")


def feature_importance(models: ModelPair, frame: DataFrame) -> DataFrame:
    """``(feature, importance)`` of the challenger, highest first: mean gain of a feature's splits as a share of all."""
    pairs = list(models.challenger.importance().items())
    return frame.sparkSession.createDataFrame(pairs, "feature string, importance double").orderBy(
        F.col("importance").desc(), "feature"
    )


def challenger_nodes(challenger: BoostedTrees, frame: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(tree, node, feature, cut, gain, value)`` of the first ``rounds`` trees; a leaf has a value, a split the rest."""
    schema = "tree int, node int, feature string, cut double, gain double, value double"
    return frame.sparkSession.createDataFrame(challenger.nodes(rounds), schema)


def first_round_scores(challenger: BoostedTrees, frame: DataFrame) -> DataFrame:
    """Adds ``first_score``, the challenger's score after its first tree."""
    margin = F.lit(challenger.base) + challenger.trees[0].leaf(challenger.columns)
    return frame.withColumn("first_score", resolved(1 / (1 + F.exp(-margin))))


def champion_gradient(
    champion: LogisticRegressionModel,
    train: DataFrame,
    columns: tuple[str, ...] = MODEL_FEATURES,
    label: str = LABEL,
    c: float = 1.0,
) -> DataFrame:
    """``(feature, gradient)`` of the penalized weighted mean loss at the fit, over the training rows; 0 at the optimum."""
    weighted = _with_weight(standardize(train, train, columns), "balanced_weight", label)
    w = [float(x) for x in champion.coefficients]
    logit = F.lit(float(champion.intercept))
    for name, value in zip(columns, w):
        logit = logit + F.col(name) * value
    error = F.col("weight") * (1 / (1 + F.exp(-logit)) - F.col(label))
    rows = weighted.withColumn("error", error)
    penalty = 1.0 / c
    sums = [((F.sum(F.col("error") * F.col(n)) + penalty * v) / F.count(F.lit(1))) for n, v in zip(columns, w)]
    sums.append(F.sum("error") / F.count(F.lit(1)))
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), s.alias("gradient")) for n, s in zip((*columns, "intercept"), sums)])
    return rows.agg(pairs.alias("pairs")).select(F.inline("pairs"))


def champion_by_hand(
    champion: LogisticRegressionModel, train: DataFrame, frame: DataFrame, columns: tuple[str, ...] = MODEL_FEATURES
) -> Column:
    """The champion's score from its coefficients and the training rows' scaling, as a column over raw features."""
    fitted = scaling(train, columns)
    logit = F.lit(float(champion.intercept))
    for name, value in zip(columns, champion.coefficients):
        sd = fitted[f"sd_{name}"]
        z = (F.col(name).cast("double") - fitted[f"mean_{name}"]) / F.when(sd > 0, sd).otherwise(F.lit(1.0))
        logit = logit + z * float(value)
    return 1 / (1 + F.exp(-logit))
