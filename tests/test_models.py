"""Model fits against independent arithmetic."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwatch.functions.rules import linear_score
from tillwatch.sources import stand_in as fx
from tillwatch.plans import marts, metrics, models

COLUMNS = ("x1", "x2", "flat")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 600
    x = rng.normal([3.0, -50.0], [2.0, 20.0], size=(n, 2))
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * (x[:, 0] - 3) - 0.05 * (x[:, 1] + 50) - 1.5)))).astype(int)
    rows = [(f"m{i}", float(a), float(b), 7.0, int(t)) for i, ((a, b), t) in enumerate(zip(x, y))]
    frame = spark.createDataFrame(rows, "merchant_id string, x1 double, x2 double, flat double, default_next_60d int")
    return x, y, frame.cache()


def _newton(x, y, weights, penalty):
    """Minimum of weighted log loss plus half the penalized squared norm, intercept free."""
    design = np.column_stack([x, np.ones(len(y))])
    beta, ridge = np.zeros(design.shape[1]), np.diag([penalty] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (weights * (p - y)) + ridge @ beta
        hessian = (design.T * (weights * p * (1 - p))) @ design + ridge
        beta = beta - np.linalg.solve(hessian, gradient)
    return beta


def test_standardize(data):
    x, _, frame = data
    found = models.standardize(frame, frame, COLUMNS).agg(
        *[F.avg(c).alias(f"m_{c}") for c in COLUMNS], *[F.stddev_pop(c).alias(f"s_{c}") for c in COLUMNS]
    ).first()
    assert [found[f"m_{c}"] for c in COLUMNS] == pytest.approx([0, 0, 0], abs=1e-9)
    assert [found[f"s_{c}"] for c in COLUMNS] == pytest.approx([1, 1, 0])
    other = frame.withColumn("flat", F.lit(9.0))
    assert models.standardize(frame, other, COLUMNS).first().flat == 2.0


def test_class_weights(data):
    _, y, frame = data
    found = {r.default_next_60d: r for r in models.class_weights(frame).collect()}
    n, pos = len(y), int(y.sum())
    assert found[1].balanced_weight == pytest.approx(n / (2 * pos))
    assert found[0].balanced_weight == pytest.approx(n / (2 * (n - pos)))
    assert (found[1].pos_weight, found[0].pos_weight) == (pytest.approx((n - pos) / pos), 1.0)
    with pytest.raises(ValueError):
        models.train_champion(frame.where("default_next_60d = 0"), COLUMNS)


@pytest.mark.parametrize("c", [1.0, 0.01])
def test_champion_is_the_penalized_optimum(data, c):
    x, y, frame = data
    model = models.train_champion(frame, ("x1", "x2"), c=c)
    z = (x - x.mean(0)) / x.std(0)
    n, pos = len(y), y.sum()
    weights = np.where(y == 1, n / (2 * pos), n / (2 * (n - pos)))
    expected = _newton(z, y, weights, 1 / c)
    assert [*model.coefficients, model.intercept] == pytest.approx(list(expected), rel=2e-4, abs=2e-4)


def test_registered_champion_is_the_optimum_to_five_decimals(spark):
    """On the training months of the stand-in tables, against Newton's steps of a plain fit."""
    import __spark_entry__ as entry

    t = entry.Tables(spark, "/root/testdata/sf0.001")
    rows = t.train().select(*[F.col(c).cast("double") for c in models.MODEL_FEATURES], "default_next_60d").toPandas().to_numpy()
    x, y = rows[:, :-1], rows[:, -1]
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
    expected = _newton(z, y, np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))), 1.0)
    champion = t.champion()
    assert [*champion.coefficients, champion.intercept] == pytest.approx(list(expected), abs=1e-5)


def test_scores_equal_on_paper_are_equal(spark):
    """Two sums of the same terms in another order differ in their last bits; their scores don't."""
    frame = spark.createDataFrame([(0.1, 0.2, 0.3), (0.3, 0.2, 0.1)], "a double, b double, c double")
    assert frame.selectExpr("a + b + c AS x").distinct().count() == 2
    assert frame.select(linear_score({"a": 1.0, "b": 1.0, "c": 1.0}, 0.0).alias("x")).distinct().count() == 1


def test_challenger_learns_and_scores(data):
    _, _, frame = data
    pair = models.train_models(frame, ("x1", "x2"), rounds=5)
    scored = models.score_both(pair, frame, frame)
    assert set(scored.columns) == set(frame.columns) | {"champ_score", "challenger_score"}
    assert scored.first().x1 == frame.first().x1
    for row in metrics.model_comparison(
        scored.withColumn("month_end", F.lit("2024-01-31")), {"a": "champ_score", "b": "challenger_score"}
    ).collect():
        assert row.roc_auc > 0.7
    importance = models.feature_importance(pair, frame).collect()
    assert sum(r.importance for r in importance) == pytest.approx(1.0)
    assert [r.importance for r in importance] == sorted((r.importance for r in importance), reverse=True)


def test_split_by_month(spark):
    frame = spark.createDataFrame([("2024-09-30",), ("2024-10-31",), ("2023-01-31",)], "d string").select(
        F.to_date("d").alias("month_end")
    )
    split = marts.oot_split(frame)
    assert marts.train_part(split).count() == 2 and marts.test_part(split).first().month == 10


def test_split_by_date_is_out_of_time(spark):
    months = fx.SPINE
    frame = spark.sql(f"SELECT explode(sequence(DATE'{months.first}', DATE'{months.last}', INTERVAL 1 MONTH)) AS d")
    frame = frame.select(F.last_day("d").alias("month_end"))
    split = marts.oot_split(frame, cut=fx.CUT, spine=months)
    train, test = marts.train_part(split), marts.test_part(split)
    assert train.agg(F.max("month_end")).first()[0] == fx.CUT < test.agg(F.min("month_end")).first()[0]
    assert train.count() + test.count() == 84
    later = marts.test_part(marts.oot_split(frame, cut=fx.CUT, embargo_days=60))
    assert later.agg(F.min("month_end")).first()[0] == date(2000, 11, 30)
    with pytest.raises(ValueError):
        marts.oot_split(frame, spine=months)


def test_assembled_features_hold_no_subquery(data):
    """The assembler's function goes to tasks with its arguments; a subquery's plan among them can't be sent."""
    _, _, frame = data
    pair = models.train_models(frame, ("x1", "x2"), rounds=1)
    plan = models.score_both(pair, frame, frame)._jdf.queryExecution().executedPlan().toString()
    assert "UDF" in plan and "ubquery" not in plan
