"""Boosted trees against a plain single-machine version of the same definition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwatch.plans import boosting

COLUMNS = ("a", "b", "c")


def rows(n, seed=3, holes=False):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.exponential(size=n), rng.integers(0, 5, n)]).astype(np.float32)
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] + (x[:, 2] == 3))))).astype(int)
    if holes:
        x[rng.random(x.shape) < 0.15] = np.nan
    return x, y


def frame_of(spark, x, y, weight):
    data = [(*(None if np.isnan(v) else float(v) for v in r), int(t), weight if t else 1.0) for r, t in zip(x, y)]
    return spark.createDataFrame(data, "a double, b double, c double, y int, w double").repartition(5)


def plain(x, y, w, rounds, step=0.1, depth=4, penalty=1.0, least=1.0):
    """Margins after all rounds and (feature, cut) of each tree's splits, trying each distinct value of each feature."""
    margin, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        splits, out = {}, np.zeros(len(y))

        def grow(node, at, level):
            G, H = g[at].sum(), h[at].sum()
            best = None
            for k in range(x.shape[1]) if level < depth else ():
                gone = np.isnan(x[at, k])
                for cut in np.unique(x[:, k][~np.isnan(x[:, k])]):
                    for side in (False, True) if gone.any() else (False,):
                        left = np.where(gone, side, x[at, k] < cut)
                        GL, HL = g[at][left].sum(), h[at][left].sum()
                        if HL < least or H - HL < least:
                            continue
                        gain = GL**2 / (HL + penalty) + (G - GL) ** 2 / (H - HL + penalty) - G**2 / (H + penalty)
                        if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, k, cut, left)
            if best is None:
                out[at] = -step * G / (H + penalty)
                return
            _, k, cut, left = best
            splits[node] = (COLUMNS[k], float(cut))
            grow(2 * node, at[left], level + 1)
            grow(2 * node + 1, at[~left], level + 1)

        grow(1, np.arange(len(y)), 0)
        trees.append(splits)
        margin = margin + out
    return margin, trees


@pytest.mark.parametrize("holes", [False, True])
def test_equals_the_plain_version(spark, holes):
    x, y = rows(200, holes=holes)
    weight = float((y == 0).sum() / (y == 1).sum())
    model = boosting.fit(frame_of(spark, x, y, weight), COLUMNS, "y", "w", rounds=12)
    margin, trees = plain(x, y, np.where(y == 1, weight, 1.0), 12)
    if not holes:
        assert [{n: (f, c) for t, n, f, c, _, _ in model.nodes() if t == k and f} for k in range(12)] == trees
    assert model.margins(x) == pytest.approx(margin, abs=1e-6)


def test_does_not_depend_on_partitions(spark):
    x, y = rows(900, seed=4)
    one = boosting.fit(frame_of(spark, x, y, 3.0), COLUMNS, "y", "w", rounds=3, bins=32)
    other = boosting.fit(frame_of(spark, x[::-1], y[::-1], 3.0).coalesce(1), COLUMNS, "y", "w", rounds=3, bins=32)
    assert one.nodes() == other.nodes()
    assert all(len(set(c for _, _, f, c, _, _ in one.nodes() if f == name)) < 32 for name in COLUMNS)


def test_scores_are_those_of_the_margins(spark):
    x, y = rows(300, holes=True)
    df = frame_of(spark, x, y, 2.0)
    model = boosting.fit(df, COLUMNS, "y", "w", rounds=2, depth=3)
    first = boosting.BoostedTrees(model.columns, model.base, model.trees[:1])
    found = df.withColumn("score", model.score()).withColumn("leaf", model.trees[0].leaf(COLUMNS)).collect()
    for r in found:
        value = np.array([[np.nan if v is None else v for v in (r.a, r.b, r.c)]], np.float32)
        assert r.score == pytest.approx(1 / (1 + np.exp(-model.margins(value)[0])))
        assert r.leaf == pytest.approx(first.margins(value)[0])
    assert sum(model.importance().values()) == pytest.approx(1)


def test_levels_shuffle_sums_alone(spark):
    """What a level shuffles is bounded by nodes, features and bins, whatever the rows."""
    df = spark.range(40_000, numPartitions=4).select(
        (F.hash("id") % 1000 / 10).alias("a"), (F.xxhash64("id") % 997).cast("double").alias("b"), F.lit(1.0).alias("c"),
        (F.hash("id") % 7 == 0).cast("int").alias("y"), F.lit(1.0).alias("w"))
    cuts = boosting.quantile_cuts(df, COLUMNS, 16)
    assert [len(c) for c in cuts] == [15, 15, 1]
    sizes = np.array([len(c) for c in cuts])
    state = boosting._binned(df, COLUMNS, cuts, "y", "w", 0.0)
    found = boosting._level(state, [], boosting.Tree.empty(4), 1, sizes, 2.0**20)
    assert found.num_rows <= (sizes + 2).sum()


def test_needs_both_classes(spark):
    x, y = rows(50)
    with pytest.raises(ValueError):
        boosting.fit(frame_of(spark, x, y * 0, 1.0), COLUMNS, "y", "w", rounds=1)


def test_a_row_of_the_stored_table_is_a_block(spark):
    """A pass handles blocks, not rows, and sums don't depend on where blocks end."""
    df = spark.range(40_000, numPartitions=2).select(
        (F.hash("id") % 1000 / 10).alias("a"), (F.xxhash64("id") % 997).cast("double").alias("b"),
        F.when(F.col("id") % 5 > 0, F.lit(1.0)).alias("c"), (F.hash("id") % 7 == 0).cast("int").alias("y"), F.lit(1.0).alias("w"))
    cuts = boosting.quantile_cuts(df, COLUMNS, 16)
    sizes = np.array([len(c) for c in cuts])
    tree = boosting.Tree.empty(4)
    tree.feature[1], tree.bin[1] = 0, 7
    tree.feature[2], tree.bin[2], tree.missing_left[2] = 2, 1, True
    sums = []
    for parts in (2, 7):
        state = boosting._binned(df.repartition(parts), COLUMNS, cuts, "y", "w", 0.0)
        assert state.count() <= 40_000 // boosting.ROWS + parts
        found = boosting._level(state, [tree], tree, 4, sizes, 2.0**20).to_pydict()
        sums.append(dict(zip(found["slot"], zip(found["g"], found["h"]))))
    assert sums[0] == sums[1]
    # each feature's bins hold each row of the two open nodes once
    width = int((sizes + 2).sum())
    left = df.where((F.col("a").cast("float") < float(cuts[0][6]))).count()
    share = sum(h for s, (_, h) in sums[0].items() if s % width < sizes[0] + 2) / sum(
        h for s, (_, h) in sums[0].items() if sizes[0] + 2 <= s % width < (sizes[:2] + 2).sum())
    assert share == 1 and 0 < left < 40_000


def test_rows_go_where_the_tree_says():
    """The walk by columns against one by rows, missing values and leaves at all depths included."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3)).astype(np.float32)
    x[rng.random(x.shape) < 0.2] = np.nan
    tree = boosting.Tree.empty(4)
    for n in (1, 2, 3, 5, 6, 10, 13):
        tree.feature[n], tree.cut[n], tree.missing_left[n] = n % 3, rng.normal(), n % 2
    expected = []
    for row in x:
        n = 1
        while (k := tree.feature[n]) >= 0:
            n = 2 * n + 1 - int(tree.missing_left[n] if np.isnan(row[k]) else row[k] < tree.cut[n])
        expected.append(n)
    columns = list(x.T)
    assert tree.node(columns, tree.cut, [np.isnan(c) for c in columns]).tolist() == expected
