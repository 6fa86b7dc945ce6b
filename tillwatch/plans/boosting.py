"""Second-order boosted trees for a 0/1 label, fitted on rows of any number.

Each round fits a tree to the gradients and second derivatives of the weighted logistic loss. A leaf's value is the Newton
step ``-step * G / (H + penalty)`` of the sums of its rows, and a split gains
``GL^2 / (HL + penalty) + GR^2 / (HR + penalty) - G^2 / (H + penalty)``; it is made where that is positive and both sides
have ``least`` of second derivatives.

* Features are 32-bit floats and cut at quantiles of the training rows: at most ``bins - 1`` cuts a feature, all distinct
  values where there are no more. Rows become bin numbers once, written as a table of blocks: a block is up to ``ROWS`` rows
  of one task, each feature's bins side by side, so that a pass over the rows costs little more than its arithmetic.
* A level of a tree is one grouped aggregation: each task sums gradients and second derivatives of its rows by (node,
  feature, bin) before anything is shuffled, so what is shuffled doesn't depend on the number of rows, and a merchant with
  a third of them is nothing special. The driver sees those sums alone: at most ``2 ** (depth - 1)`` nodes times features times
  bins, whatever the input.
* Gradients are whole multiples of a power of two so small that all sums stay below 2^52: sums are exact in any order,
  and so the fit depends neither on partitions nor on retried tasks.
* The rows' margins are written again every ``KEEP`` rounds; the trees since then are evaluated where they are needed.

A missing value goes to the side of a node that gains more, the right one among equals. Equal gains go to the feature named
first and the lowest cut. Without rows, or with one class only, there is nothing to fit: that is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.session import HandOffs, importable

#: rounds after which the rows' margins are written again
KEEP = 10
#: rows of a block: its columns stay in a core's cache
ROWS = 16_384
#: a smaller gain is rounding
LEAST_GAIN = 1e-6
#: relative error of the quantiles is 1 / QUANTILE_ACCURACY of the rows
QUANTILE_ACCURACY = 20_000


@dataclass
class Tree:
    """Nodes by heap number: 1 is the root, ``2 n`` the left and ``2 n + 1`` the right child of ``n``."""

    feature: np.ndarray
    cut: np.ndarray  # rows below it go left
    bin: np.ndarray  # the same in bin numbers
    missing_left: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 2 << depth
        return cls(np.full(n, -1), np.zeros(n, np.float32), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n))

    def node(self, values: list[np.ndarray], cuts: np.ndarray, missing: list[np.ndarray | None]) -> np.ndarray:
        """Where each row ends; ``values``: the rows' features one by one, ``cuts``: those of the tree in the same terms.

        ``missing`` has a flag for each row, or nothing for a feature that no row lacks. A missing value is below no cut.
        """
        rows, small = len(values[0]), np.uint8 if len(self.feature) <= 256 else np.uint32

        def below(node: int) -> np.ndarray:
            feature = self.feature[node]
            if feature < 0:
                return np.full(rows, node, small)
            left = values[feature] < values[feature].dtype.type(cuts[node])
            if self.missing_left[node] and missing[feature] is not None:
                left |= missing[feature]
            if self.feature[2 * node] < 0 and self.feature[2 * node + 1] < 0:
                return small(2 * node + 1) - left.astype(small)
            on_left, on_right = below(2 * node), below(2 * node + 1)
            # all bits of one side or of the other
            return on_right ^ ((on_left ^ on_right) & -left.astype(small))

        return below(1)

    def leaf(self, columns: tuple[str, ...], node: int = 1) -> Column:
        """Leaf value of a row as conditions over its columns; for single trees, as a whole model is too wide for that."""
        if self.feature[node] < 0:
            return F.lit(float(self.value[node]))
        value = F.col(columns[self.feature[node]]).cast("float")
        below = F.when(value.isNull() | F.isnan(value), F.lit(bool(self.missing_left[node]))).otherwise(
            value < F.lit(float(self.cut[node])).cast("float")
        )
        return F.when(below, self.leaf(columns, 2 * node)).otherwise(self.leaf(columns, 2 * node + 1))


@dataclass
class BoostedTrees:
    columns: tuple[str, ...]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def margins(self, values: np.ndarray) -> np.ndarray:
        """Sum of leaf values of each row of raw 32-bit features."""
        out = np.empty(len(values))
        for a in range(0, len(values), ROWS):
            columns = list(np.ascontiguousarray(values[a : a + ROWS].T))
            out[a : a + ROWS] = _advanced(np.full(len(columns[0]), self.base), columns, self.trees, _missing(columns, np.isnan), "cut")
        return out

    def score(self) -> Column:
        """Probability of label 1 as a column over ``columns``; batches of rows go through the trees together."""
        model = self
        importable(SparkSession.getActiveSession())

        @F.pandas_udf("double")
        def scored(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in parts:
                values = np.column_stack([np.asarray(c, np.float32) for c in columns])
                yield pd.Series(1 / (1 + np.exp(-model.margins(values))))

        return scored(*[F.col(c).cast("float") for c in self.columns])

    def importance(self) -> dict[str, float]:
        """Mean gain of each feature's splits, as shares of their sum."""
        total, splits = np.zeros(len(self.columns)), np.zeros(len(self.columns))
        for tree in self.trees:
            made = tree.feature >= 0
            np.add.at(total, tree.feature[made], tree.gain[made])
            np.add.at(splits, tree.feature[made], 1)
        mean = np.divide(total, splits, out=np.zeros_like(total), where=splits > 0)
        return dict(zip(self.columns, (mean / (mean.sum() or 1)).tolist()))

    def nodes(self, rounds: int | None = None) -> list[tuple]:
        """(tree, node, feature, cut, gain, value) of all nodes of the first ``rounds`` trees; leaves have no feature."""
        out = []
        for t, tree in enumerate(self.trees[:rounds]):
            open_ = [1]
            while open_:
                n = open_.pop()
                if tree.feature[n] >= 0:
                    out.append((t, n, self.columns[tree.feature[n]], float(tree.cut[n]), float(tree.gain[n]), None))
                    open_ += [2 * n, 2 * n + 1]
                else:
                    out.append((t, n, None, None, None, float(tree.value[n])))
        return sorted(out, key=lambda r: r[:2])


def quantile_cuts(rows: DataFrame, columns: tuple[str, ...], bins: int) -> list[np.ndarray]:
    """Distinct quantiles of each column, from one pass: at most ``bins - 1`` numbers a column."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("float"), shares, QUANTILE_ACCURACY).alias(c) for c in columns]).first()
    cuts = [np.unique(np.array(found[c] or [], np.float32)) for c in columns]
    return [c[~np.isnan(c)] for c in cuts]


BLOCK = "n int, bins binary, y binary, w binary, margin binary"


def _binned(rows: DataFrame, columns: tuple[str, ...], cuts: list[np.ndarray], label: str, weight: str, base: float) -> DataFrame:
    """Blocks of rows: bins (16 bits, a feature after the other; one past the last is missing), y, w and margin."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(parts)
        if held.column("w").null_count:
            raise ValueError("a training row has no weight")
        n, of = held.num_rows, lambda k: held.column(k).to_numpy()
        bins = np.empty((len(cuts), n), "<u2")
        for k, cut in enumerate(cuts):
            value = of(k).astype(np.float32)
            bins[k] = np.where(np.isnan(value), len(cut) + 1, np.searchsorted(cut, value, "right"))
        return _block(n, bins.tobytes(), of(len(cuts)).tobytes(), of(len(cuts) + 1).tobytes(), np.full(n, base))

    def run(batches):
        held, n = [], 0
        for batch in batches:
            while n + batch.num_rows >= ROWS:
                yield block([*held, batch.slice(0, ROWS - n)])
                held, batch, n = [], batch.slice(ROWS - n), 0
            if batch.num_rows:
                held, n = [*held, batch], n + batch.num_rows
        if n:
            yield block(held)

    shaped = rows.select(*[F.col(c).cast("float").alias(f"f{k}") for k, c in enumerate(columns)],
                         F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    return shaped.mapInArrow(run, BLOCK)


def _block(n: int, bins: bytes, y: bytes, w: bytes, margin: np.ndarray) -> pa.RecordBatch:
    data = ([n], [bins], [y], [w], [margin.tobytes()])
    types = (pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(data, types)], ["n", "bins", "y", "w", "margin"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield {name: batch.column(name)[at].as_py() for name in batch.schema.names}


def _classes(state: DataFrame) -> DataFrame:
    """(y, n, top) of each block: rows with a label and their greatest weight."""

    def run(batches):
        for block in _blocks(batches):
            y, w = np.frombuffer(block["y"]), np.frombuffer(block["w"])
            found, at, n = np.unique(y, return_inverse=True, return_counts=True)
            top = np.full(len(found), -np.inf)
            np.maximum.at(top, at, w)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n), pa.array(top)], ["y", "n", "top"])

    return state.mapInArrow(run, "y double, n long, top double")


def _missing(columns: list[np.ndarray], test) -> list[np.ndarray | None]:
    return [gone if gone.any() else None for gone in map(test, columns)]


def _advanced(margin: np.ndarray, columns: list[np.ndarray], trees: list[Tree], missing: list, cuts: str = "bin") -> np.ndarray:
    for tree in trees:
        margin = margin + tree.value[tree.node(columns, getattr(tree, cuts), missing)]
    return margin


def _read(block: dict, sizes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray | None], np.ndarray]:
    bins = list(np.frombuffer(block["bins"], "<u2").reshape(len(sizes), block["n"]))
    missing = [gone if gone.any() else None for gone in (b > size for b, size in zip(bins, sizes.astype(np.uint16)))]
    return bins, missing, np.frombuffer(block["margin"])


def _level(state: DataFrame, trees: list[Tree], tree: Tree, first: int, sizes: np.ndarray, scale: float) -> dict[int, tuple[float, float]]:
    """Sums of gradients and second derivatives by slot (node, feature, bin) of the open nodes from ``first`` on."""
    offsets = np.concatenate([[0], np.cumsum(sizes + 2)])
    width = int(offsets[-1])

    def run(batches):
        sums = np.zeros((2, first, width))
        for block in _blocks(batches):
            bins, missing, margin = _read(block, sizes)
            margin = _advanced(margin, bins, trees, missing)
            node = tree.node(bins, tree.bin, missing).astype(np.int64) - first
            y, w = np.frombuffer(block["y"]), np.frombuffer(block["w"])
            p = 1 / (1 + np.exp(-margin))
            g, h = np.rint(w * (p - y) * scale), np.rint(np.maximum(w * p * (1 - p), 1e-16) * scale)
            if (node < 0).any():  # others have come to a leaf higher up
                mine = np.flatnonzero(node >= 0)
                node, g, h, bins = node[mine], g[mine], h[mine], [b[mine] for b in bins]
            for k, size in enumerate((sizes + 2).tolist()):
                slot, here = node * size + bins[k], slice(int(offsets[k]), int(offsets[k + 1]))
                for of, value in zip(sums, (g, h)):
                    of[:, here] += np.bincount(slot, value, minlength=first * size).reshape(first, size)
        sums = sums.reshape(2, -1)
        at = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], ["slot", "g", "h"])

    parts = state.mapInArrow(run, "slot long, g double, h double")
    # at most nodes x features x bins rows
    return parts.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()


def _split(g: np.ndarray, h: np.ndarray, penalty: float, least: float) -> tuple[float, int, bool] | None:
    """Best gain, bin and side of the missing of one feature; the last bin holds the missing."""
    total_g, total_h = g.sum(), h.sum()
    best = None
    for missing_left in (False, True):
        left_g, left_h = np.cumsum(g[:-2]) + missing_left * g[-1], np.cumsum(h[:-2]) + missing_left * h[-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - total_g**2 / (total_h + penalty)
        gain = np.where((left_h >= least) & (right_h >= least), gain, -np.inf)
        if len(gain) and gain.max() > LEAST_GAIN and (best is None or gain.max() > best[0]):
            best = (float(gain.max()), int(gain.argmax()) + 1, missing_left)
        if not g[-1] and not h[-1]:
            break
    return best


def fit(
    train: DataFrame,
    columns: tuple[str, ...],
    label: str,
    weight: str,
    rounds: int = 100,
    step: float = 0.1,
    depth: int = 4,
    penalty: float = 1.0,
    least: float = 1.0,
    bins: int = 256,
    base: float = 0.0,
) -> BoostedTrees:
    """Trees fitted to ``train``; ``weight`` is a column of row weights, ``base`` the margin before the first tree."""
    importable(train.sparkSession)
    model = BoostedTrees(tuple(columns), base)
    cuts = quantile_cuts(train, model.columns, bins)
    sizes = np.array([len(c) for c in cuts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes + 2)])
    with HandOffs() as held:
        rows = _binned(train.where(F.col(label).isNotNull()), model.columns, cuts, label, weight, base)
        state = _few_sums(held, held.write(rows, "boost-rows"))
        n, top, classes = _classes(state).agg(F.sum("n"), F.max("top"), F.count_distinct("y")).first()
        if classes != 2:
            raise ValueError("training needs rows of both classes")
        scale = 2.0 ** (51 - int(np.ceil(np.log2(n * max(top, 1.0)))))
        since = 0
        for done in range(rounds):
            tree = Tree.empty(depth)
            for level in range(depth):
                first = 1 << level
                open_ = [x for x in range(first, 2 * first) if level == 0 or tree.feature[x // 2] >= 0]
                if not open_:
                    break
                found = _level(state, model.trees[since:], tree, first, sizes, scale)
                g, h = (np.zeros(first * int(offsets[-1])) for _ in range(2))
                slots = found.column("slot").to_numpy()
                g[slots], h[slots] = found.column("g").to_numpy() / scale, found.column("h").to_numpy() / scale
                for x in open_:
                    _grow(tree, x, [(g[a:b], h[a:b]) for a, b in ((offsets[-1] * (x - first) + offsets[k : k + 2]).tolist() for k in range(len(sizes)))],
                          cuts, step, penalty, least)
            model.trees.append(tree)
            if len(model.trees) - since == KEEP and done + 1 < rounds:
                state, since = _few_sums(held, held.write(_moved(state, model.trees[since:], sizes), "boost-rows")), len(model.trees)
    return model


def _few_sums(held: HandOffs, table: DataFrame) -> DataFrame:
    """The table written last, as read by a session of its own for the many short jobs over it.

    What these shuffle is bounded, so a few partitions do, and there is nothing to plan anew while they run. A row is a
    block, so a batch has few.
    """
    session = table.sparkSession.newSession()
    for name, value in (
        ("spark.sql.adaptive.enabled", "false"), ("spark.sql.shuffle.partitions", "4"),
        ("spark.sql.parquet.columnarReaderBatchSize", "4"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "4"),
    ):
        session.conf.set(name, value)
    return session.read.schema(table.schema).parquet(held.last)


def _grow(tree: Tree, x: int, sums: list, cuts: list[np.ndarray], step: float, penalty: float, least: float) -> None:
    """Splits node ``x`` where that gains, and gives its children, or else itself, a value."""
    value = lambda g, h: -step * g / (h + penalty)
    found = [(s[0], -k, s) for k, (g, h) in enumerate(sums) if (s := _split(g, h, penalty, least))]
    g, h = sums[0]
    tree.value[x] = value(g.sum(), h.sum())
    if not found:
        return
    gain, k, (_, at, missing_left) = max(found, key=lambda f: f[:2])
    g, h = sums[-k]
    tree.feature[x], tree.bin[x], tree.cut[x], tree.gain[x], tree.missing_left[x] = -k, at, cuts[-k][at - 1], gain, missing_left
    left_g, left_h = g[:at].sum() + missing_left * g[-1], h[:at].sum() + missing_left * h[-1]
    tree.value[2 * x], tree.value[2 * x + 1] = value(left_g, left_h), value(g.sum() - left_g, h.sum() - left_h)


def _moved(state: DataFrame, trees: list[Tree], sizes: np.ndarray) -> DataFrame:
    def run(batches):
        for block in _blocks(batches):
            bins, missing, margin = _read(block, sizes)
            yield _block(block["n"], block["bins"], block["y"], block["w"], _advanced(margin, bins, trees, missing))

    return state.mapInArrow(run, BLOCK)
