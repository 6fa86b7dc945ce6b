"""Mixing to target weights: token weights raked to source, language and topic marginals, then calibrated sampling.

Tokens are summed by cell (source, language, topic) where values outside the targets are one class "other", so cells
are at most the product of the lengths of the target lists, each plus one: that bound makes them small enough to rake
in the driver and to broadcast. Iterative proportional fitting scales the cells to one marginal after the other until
all three hold. A class without tokens gives its target to the others; "other" keeps its natural share unless a target
names it; null values are "other".

A document's probability is that of its cell: the raked share of tokens against the natural one, times a factor that
makes the expected tokens ``keep`` times all tokens. Where that exceeds 1 the probability is 1, the factor is raised for
the rest, and ``weight`` carries what sampling can't: over sampled documents, tokens times ``weight`` have the target
marginals in expectation. Without a ``keep``, the largest one is taken at which no weight is needed: every marginal of
the expected kept tokens is within ``TOLERANCE`` of all tokens of the raked one, which is the target wherever the cells
that have tokens can meet it. That can be a small share where one class is scarce against its target, so ``floor`` is a
share of tokens that is kept in any case; what sampling can't reach at that floor is left to weights. ``sampled`` gives the
kept rows themselves, ``weights`` the weight of each kept row at which tokens times weight have the target marginals, from the
kept rows alone, and ``marginals`` what each class has, wants, and has after each of these steps. The draw is a digest of seed and ``doc_id`` (of the text where the id is null), so it depends
neither on partitions nor on order, and repeated rows share it.

Defined results: null texts have no tokens and the probability of their cell, or ``keep`` if the cell has no tokens;
empty tables give no rows; other columns are ignored, and those read may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.session import hand_off

OTHER = "other"
#: share of all tokens by which a marginal may miss its raked value where ``keep`` is derived
TOLERANCE = 0.005
AXES = ("source", "lang", "topic")
#: shares of tokens that the registered query and the pipeline mix to
TARGETS = {
    "source": {f"src{i}": 0.05 for i in range(20)},
    "lang": {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1},
    "topic": {"prose": 0.9, "tabular": 0.04, "licensed": 0.02, "contact": 0.04},
}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def surface_topic(text: Column) -> Column:
    """A stand-in for a topic column: what the surface of a text shows."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "tabular")
        .when(F.contains(text, F.lit("Licensed under")), "licensed")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("http")), "contact")
        .otherwise("prose")
    )


def rake(tokens: np.ndarray, targets: list[np.ndarray], rounds: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """Shares of the cells of ``tokens`` that have the marginals ``targets``, one for each axis.

    Targets are taken where the axis has tokens, and scaled to one.
    """
    shares = tokens / max(tokens.sum(), 1)
    if not tokens.sum():
        return shares
    wanted = []
    for axis, target in enumerate(targets):
        have = shares.sum(tuple(k for k in range(shares.ndim) if k != axis)) > 0
        part = np.where(have, target, 0.0)
        wanted.append(part / part.sum() if part.sum() else have / have.sum())
    for _ in range(rounds):
        worst = 0.0
        for axis, target in enumerate(wanted):
            now = shares.sum(tuple(k for k in range(shares.ndim) if k != axis))
            factor = np.divide(target, now, out=np.zeros_like(now), where=now > 0)
            worst = max(worst, float(np.abs(now - target).max()))
            shape = [1] * shares.ndim
            shape[axis] = -1
            shares = shares * factor.reshape(shape)
        if worst < tolerance:
            break
    return shares


def calibrate(tokens: np.ndarray, shares: np.ndarray, keep: float) -> np.ndarray:
    """Probability of each cell: in proportion to raked by natural share, at most 1, with ``keep`` of all tokens expected."""
    total = tokens.sum()
    ratio = np.divide(shares * total, tokens, out=np.zeros(tokens.shape), where=tokens > 0)
    if not total or not ratio.any():
        return np.full(tokens.shape, min(keep, 1.0))
    reachable = tokens[ratio > 0].sum()
    budget = min(keep * total, reachable)
    full = np.zeros(tokens.shape, bool)
    while True:
        left = ~full & (ratio > 0)
        open_ = (tokens * ratio)[left].sum()
        factor = (budget - tokens[full].sum()) / open_ if open_ > 0 else 0.0
        more = left & (factor * ratio > 1 + 1e-12)
        if not more.any():
            break
        full |= more
    probability = np.where(full, 1.0, np.minimum(ratio * factor, 1.0))
    return np.where(tokens > 0, probability, min(keep, 1.0))


def reachable_keep(tokens: np.ndarray, shares: np.ndarray, tolerance: float = TOLERANCE) -> float:
    """The largest ``keep`` at which each marginal of the expected kept tokens is within ``tolerance`` of that of ``shares``.

    While the factor of ``calibrate`` grows, cells reach probability 1 one after another. Between two of these points
    kept tokens are linear in the factor, so the last factor within the tolerance is found exactly.
    """
    total = tokens.sum()
    ratio = np.divide(shares * total, tokens, out=np.zeros(tokens.shape), where=tokens > 0)
    open_ = ratio > 0
    if not open_.any():
        return 1.0
    n, r, part = tokens[open_], ratio[open_], shares[open_]
    where = np.nonzero(open_)
    member = np.concatenate([np.equal.outer(np.arange(size), at) for size, at in zip(tokens.shape, where)]).astype(float)
    target = member @ part / part.sum()
    with np.errstate(over="ignore"):
        kept = n * np.minimum(np.unique(1 / r)[:, None] * r, 1.0)
    sums = kept.sum(1)
    gap = kept @ member.T - sums[:, None] * target
    excess = np.concatenate([gap, -gap], 1) - tolerance * sums[:, None]
    for low, high, a, b in zip(excess[-2::-1], excess[:0:-1], sums[-2::-1], sums[:0:-1]):
        if ((low > 0) & (high > 0)).any():
            continue
        cross = np.divide(low, low - high, out=np.zeros(low.shape), where=low != high)
        upper = cross[high > 0].min(initial=1.0)
        if cross[(low > 0)].max(initial=0.0) <= upper:
            return float((a + upper * (b - a)) / total)
    return float(sums[0] / total)


def _class(value: Column, names: list[str]) -> Column:
    return F.when(value.isin(names), value).otherwise(F.lit(OTHER)) if names else F.lit(OTHER)


class Mixture:
    """Cells of a document table raked to targets: what a row's cell, draw and weight are, as columns over its own row.

    ``targets``: for each of ``source``, ``lang`` and ``topic`` the wanted share of tokens by value. ``keep``: the share
    of tokens expected to stay; None for the largest at which the kept ones have the marginals without weights, but not less
    than ``floor``.
    """

    def __init__(
        self,
        docs: DataFrame,
        targets: dict[str, dict[str, float]],
        keep: float | None,
        floor: float = 0.0,
        seed: str = "mix",
        topic: Column | None = None,
        tokens: Column | None = None,
        id_col: str = "doc_id",
        text_col: str = "text",
        source_col: str = "source",
        lang_col: str = "lang",
    ):
        text = F.coalesce(F.col(text_col), F.lit(""))
        self.docs, self.targets, self.id_col = docs, targets, id_col
        self.names = {axis: [n for n in targets.get(axis, {}) if n != OTHER] for axis in AXES}
        values = {"source": F.col(source_col), "lang": F.col(lang_col), "topic": surface_topic(text) if topic is None else topic}
        self.classes = [_class(values[axis], self.names[axis]).alias(axis) for axis in AXES]
        self.tokens = (word_count(text) if tokens is None else tokens.cast("long")).alias("n_tokens")
        unit = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(text)))
        digest = F.md5(F.concat(F.lit(f"{seed}|"), unit))
        self.draw = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)).alias("draw")
        self.lists = [[*self.names[axis], OTHER] for axis in AXES]
        self.keep, self.floor = keep, floor

    def fitted(self, rows: DataFrame) -> "Mixture":
        """Counts the cells of ``rows`` (the axes and n_tokens) and rakes them."""
        # at most the product of the target lists, whatever the input
        counted = np.zeros([len(x) for x in self.lists])
        for *cell, n in rows.groupBy(*AXES).agg(F.sum("n_tokens")).collect():
            counted[tuple(x.index(v) for x, v in zip(self.lists, cell))] = n or 0
        wanted = []
        for axis, (axis_name, of) in enumerate(zip(AXES, self.lists)):
            natural = counted.sum(tuple(k for k in range(3) if k != axis)) / max(counted.sum(), 1)
            given = self.targets.get(axis_name, {})
            named = np.array([given.get(v, 0.0) for v in of])
            if OTHER not in given:
                named = named / (named.sum() or 1) * (1 - natural[-1])
                named[-1] = natural[-1]
            wanted.append(named)
        self.counted, self.shares = counted, rake(counted, wanted)
        if self.keep is None:
            self.keep = max(reachable_keep(counted, self.shares), self.floor)
        self.chance = calibrate(counted, self.shares, self.keep)
        return self

    def ratio(self) -> np.ndarray:
        """Raked by natural share of each cell; 0 where it has no tokens."""
        return np.divide(self.shares * self.counted.sum(), self.counted, out=np.zeros(self.counted.shape), where=self.counted > 0)

    def cells(self) -> DataFrame:
        """Probability and weight by cell; a bounded table."""
        weight = np.divide(self.ratio() * self.keep, self.chance, out=np.zeros(self.chance.shape), where=self.chance > 0)
        rows = [
            (*(self.lists[k][i] for k, i in enumerate(at)), float(self.chance[at]), float(weight[at])) for at in np.ndindex(self.chance.shape)
        ]
        return self.docs.sparkSession.createDataFrame(rows, "source string, lang string, topic string, probability double, weight double")


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]], keep: float | None, floor: float = 0.0, **columns) -> DataFrame:
    """doc_id, source, lang, topic (as classes), n_tokens, probability, weight, kept for each row.

    Arguments as in ``Mixture``.
    """
    m = Mixture(docs, targets, keep, floor, **columns)
    table = hand_off(docs.select(F.col(m.id_col).alias("doc_id"), *m.classes, m.tokens, m.draw), "mix-tokens")
    return table.join(F.broadcast(m.fitted(table).cells()), list(AXES)).select(
        "doc_id", *AXES, "n_tokens", "probability", "weight", (F.col("draw") < F.col("probability")).alias("kept")
    )


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name in docs.columns:
        name += "_"
    return name


def sampled(docs: DataFrame, targets: dict[str, dict[str, float]], keep: float | None, floor: float = 0.0, **columns) -> DataFrame:
    """The kept rows of ``docs``, with its columns. Each row is judged by its own cell and draw, so none is moved."""
    m = Mixture(docs, targets, keep, floor, **columns)
    m.fitted(docs.select(*m.classes, m.tokens))
    cell = _free(docs, "_cell")
    table = m.cells().select(F.struct(*AXES).alias(cell), F.col("probability").alias(f"{cell}p"))
    marked = docs.withColumn(cell, F.struct(*m.classes)).join(F.broadcast(table), cell)
    return marked.where(m.draw < F.col(f"{cell}p")).select(*docs.columns)


def weights(docs: DataFrame, targets: dict[str, dict[str, float]], name: str = "weight", **columns) -> DataFrame:
    """``docs`` with a weight for each row: tokens times weight have the target marginals, and the sum of tokens stays.

    A class that has no tokens can't be weighted up; its target goes to the others.
    """
    m = Mixture(docs, targets, 1.0, **columns)
    m.fitted(docs.select(*m.classes, m.tokens))
    ratio, cell = m.ratio(), _free(docs, "_cell")
    rows = [(*(m.lists[k][i] for k, i in enumerate(at)), float(ratio[at])) for at in np.ndindex(ratio.shape)]
    table = docs.sparkSession.createDataFrame(rows, "source string, lang string, topic string, ratio double")
    table = table.select(F.struct(*AXES).alias(cell), F.col("ratio").alias(f"{cell}r"))
    marked = docs.withColumn(cell, F.struct(*m.classes)).join(F.broadcast(table), cell)
    return marked.select(*[c for c in docs.columns if c != name], F.col(f"{cell}r").alias(name))


def marginals(docs: DataFrame, targets: dict[str, dict[str, float]], keep: float | None, floor: float = 0.0, **columns) -> DataFrame:
    """axis, value, natural, target, kept and weighted: shares of tokens of each class, as they are, as wanted, expected of
    the kept rows, and of these with weights. Where ``weighted`` isn't the target, there are no tokens to meet it with."""
    m = Mixture(docs, targets, keep, floor, **columns)
    m.fitted(docs.select(*m.classes, m.tokens))
    kept, out = m.counted * m.chance, []
    sums = lambda x, k: x.sum(tuple(j for j in range(3) if j != k)) / max(x.sum(), 1e-300)
    for k, axis in enumerate(AXES):
        for i, value in enumerate(m.lists[k]):
            wanted = targets.get(axis, {}).get(value)
            out.append((axis, value, float(sums(m.counted, k)[i]), wanted, float(sums(kept, k)[i]), float(sums(m.shares, k)[i])))
    return docs.sparkSession.createDataFrame(out, "axis string, value string, natural double, target double, kept double, weighted double")
