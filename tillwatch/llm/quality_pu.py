"""Quality classifier learnt from trusted positives and unlabelled text by the non-negative unbiased risk.

Only positives are labelled: trusted documents, and a sample of all documents, of which a share ``prior`` is positive
too. With losses of a score for a positive and a negative document, the risk of a classifier is

    prior * R_p(positive)  +  max(0, R_u(negative) - prior * R_p(negative))

The second term estimates the risk on negatives; where it falls below zero the fit has begun to tell the sampled
positives from their like, and the step goes the opposite way (non-negative correction).

``prior`` is estimated first. A first fit scores positives and unlabelled documents that it hasn't seen. For every
threshold, the unlabelled share above it is at least ``prior`` times the positives' share, so the smallest quotient
over thresholds bounds the prior from above, with half a standard error of both shares as a margin.

Features are shares of neighbouring byte classes in a text (letters, capitals, digits, marks, symbols, line ends ...)
and a few measures of words and lines, so no word list and no language is assumed. Neither labels nor ids, language or
source are inputs of a score. The network is small and fitted in the driver on a sample of ``positives`` and
``unlabelled`` documents at most, picked by a hash of their ids; scoring covers every whole text.

Defined results: a null or empty text has a feature row like any other and gets a score; rows are scored one by one, so
repeated rows get equal scores, and a null ``doc_id`` counts as not held out; labels of ids without a document and
contradicting labels teach nothing; without a trusted positive or an unlabelled document every score is 0.5; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.ngram_rules import repeated_lines, repeated_words, trusted_ids
from tillwatch.llm.texts import Runs, id_and_text, map_batches, steps, strings, sums, words_of

#: documents of either kind that a fit uses at most
POSITIVES, UNLABELLED = 6_000, 12_000
HIDDEN, STEPS, BATCH, SEED = 24, 1_600, 512, 7
#: text bytes whose features are made together: some 60 bytes of whole numbers for each are held meanwhile
SLICE = 1 << 19
#: step against an overfitted negative risk
GAMMA = 1.0


def _classes() -> np.ndarray:
    """Class of each byte."""
    of = np.full(256, 15, np.uint8)  # bytes of other characters
    of[:128] = 14  # other ASCII
    groups = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", " ", "\n", ".,;:", "!?", "#*$%&", "|<>", "()[]{}", "'\"-", "/\\@_=+~^`"]
    for k, group in enumerate(groups):
        of[list(group.encode())] = k
    return of


CLASS = _classes()
#: edges at which measures of words and lines are cut into steps
EDGES = [np.array(e) for e in ([2, 5, 10, 20, 50, 100, 1000], [2, 3, 4, 5, 6, 8, 12], [0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95], [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8], [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8])]
WIDTH = 256 + 16 + sum(len(e) + 1 for e in EDGES)


def features(texts: pa.StringArray) -> np.ndarray:
    """One row of ``WIDTH`` numbers in 0..1 for each text, whatever the others; made of ``SLICE`` bytes of texts at a time."""
    table = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = [_features(strings(part.column("text"))) for part in steps([table], limit=SLICE)]
    return np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.float32)


def _features(texts: pa.StringArray) -> np.ndarray:
    n, out = len(texts), np.zeros((len(texts), WIDTH), np.float32)
    ends = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8, int(ends[-1] - ends[0]), int(ends[0])) if data and ends[-1] > ends[0] else np.empty(0, np.uint8)
    size, of = np.diff(ends).astype(np.int64), CLASS[raw]
    text = np.repeat(np.arange(n), size)
    inside = text[1:] == text[:-1]
    pairs = (text[:-1] * 256 + of[:-1] * np.int64(16) + of[1:])[inside] if len(raw) > 1 else np.empty(0, np.int64)
    out[:, :256] = np.sqrt(np.bincount(pairs, minlength=256 * n)[: 256 * n].reshape(n, 256) / np.maximum(size - 1, 1)[:, None])
    out[:, 256:272] = np.bincount(text * 16 + of, minlength=16 * n)[: 16 * n].reshape(n, 16) / np.maximum(size, 1)[:, None]
    codes, words, cut = words_of(texts)
    n_words = np.diff(cut)
    letters = sums(pc.utf8_length(words).to_numpy(zero_copy_only=False)[codes], cut)
    owner = np.repeat(np.arange(n), n_words)
    distinct = np.bincount(np.unique(owner * max(1, len(words)) + codes) // max(1, len(words)), minlength=n)
    lines = pc.add(pc.count_substring(texts, "\n"), 1).to_numpy(zero_copy_only=False)
    some = np.maximum(n_words, 1)
    # texts repeat common words more the longer they are: distinct words against the square root of the length
    measures = [
        n_words,
        letters / some,
        distinct / some,
        repeated_words(codes, max(1, len(words)), cut) / some,
        repeated_lines(texts) / np.maximum(lines, 1),
    ]
    at = 272
    for value, edges in zip(measures, EDGES):
        out[np.arange(n), at + np.searchsorted(edges, value, side="right")] = 1.0
        at += len(edges) + 1
    return out


class Network:
    """Scores by one hidden layer; weights are plain arrays."""

    def __init__(self, weights: list[np.ndarray] | None):
        self.weights = weights

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        mean, w, b, v, c = self.weights
        return np.maximum((x - mean) @ w + b, 0) @ v + c[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, seed: int = SEED) -> Network:
    """Minimises the non-negative risk with logistic losses by Adam."""
    if not len(positive) or not len(unlabelled):
        return Network(None)
    rng = np.random.default_rng(seed)
    mean = np.concatenate([positive, unlabelled]).mean(0)
    width = positive.shape[1]
    params = [rng.normal(0, (2 / width) ** 0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    params = [p.astype(np.float32) for p in params]
    p_all, u_all = (positive - mean).astype(np.float32), (unlabelled - mean).astype(np.float32)
    rounds = max(1, len(u_all) // BATCH)
    for _ in range(max(1, steps // rounds)):
        p_order, u_order = rng.permutation(len(p_all)), rng.permutation(len(u_all))
        for p_part, u_part in zip(np.array_split(p_order, rounds), np.array_split(u_order, rounds)):
            if not len(p_part):
                p_part = p_order[:BATCH]
            x = np.concatenate([p_all[p_part], u_all[u_part]])
            w, b, v, c = params
            hidden = np.maximum(x @ w + b, 0)
            z = np.clip(hidden @ v + c[0], -40, 40)
            s = 1 / (1 + np.exp(-z))
            is_p = np.arange(len(x)) < len(p_part)
            n_p, n_u = is_p.sum(), (~is_p).sum()
            soft = np.logaddexp(0, z)  # loss of calling a document positive that is negative
            negative = soft[~is_p].mean() - prior * soft[is_p].mean()
            # derivatives by z of the two parts of the risk
            up = np.where(is_p, prior * (s - 1) / n_p, 0.0)
            down = np.where(is_p, -prior * s / n_p, s / n_u)
            g = (up + down if negative >= 0 else -GAMMA * down).astype(np.float32)
            back = np.outer(g, v) * (hidden > 0)
            grads = [x.T @ back + 1e-4 * w, back.sum(0), hidden.T @ g + 1e-4 * v, g.sum(keepdims=True)]
            t += 1
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad**2
                params[k] = params[k] - 0.01 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Network([mean.astype(np.float32), *(p.astype(np.float32) for p in params)])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the smallest quotient of shares above a threshold, with a margin."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    found = []
    for k in (0, 1):  # each half is scored by a fit on the other
        network = fit(positive[k::2], unlabelled[k::2], 0.5, steps=STEPS // 4, seed=SEED + k)
        p, u = np.sort(network.logits(positive[1 - k :: 2])), np.sort(network.logits(unlabelled[1 - k :: 2]))
        cuts = np.quantile(p, np.linspace(0, 0.9, 46))
        above_p = 1 - np.searchsorted(p, cuts, side="left") / len(p)
        above_u = 1 - np.searchsorted(u, cuts, side="left") / len(u)
        margin = np.sqrt(np.maximum(above_u * (1 - above_u), 1 / len(u)) / len(u)) + np.sqrt(np.maximum(above_p * (1 - above_p), 1 / len(p)) / len(p))
        found.append(np.min((above_u + margin / 2) / np.maximum(above_p, 1e-9)))
    return float(np.clip(np.mean(found), 0.01, 0.99))


def _sample(ids: DataFrame, most: int, kind: int) -> DataFrame:
    """At most ``most`` ids by the order of their hashes."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("kind", F.lit(kind))


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[Network, float]:
    """The fitted network and the estimated prior. Labels of held-out ids aren't read."""
    slim = id_and_text(docs)
    usable = labels.where(~held_out(F.col("doc_id")))
    chosen = _sample(trusted_ids(usable), positives, 1).unionByName(
        _sample(slim.where("doc_id IS NOT NULL").select("doc_id").distinct(), unlabelled, 0)
    )
    # 18,000 ids at most
    texts = slim.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "kind").agg(F.min("text").alias("text"))

    def run(batches):
        Runs.empty_all()
        for batch in steps(batches):
            rows = features(strings(batch.column("text"))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("kind"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "kind", "row"])

    got = sorted(map_batches(texts, run, "doc_id long, kind int, row binary").collect(), key=lambda r: (r.kind, r.doc_id))
    matrix = np.frombuffer(b"".join(bytes(r.row) for r in got), np.float16).reshape(-1, WIDTH).astype(np.float32)
    kind = np.array([r.kind for r in got], np.int64)
    p, u = matrix[kind == 1], matrix[kind == 0]
    prior = estimate_prior(p, u)
    return fit(p, u, prior), prior


def with_score(docs: DataFrame, network: Network, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns of ``docs``, whatever they are, and the score of each row's whole text."""
    kept = [c for c in docs.columns if c != score_col]
    kinds = dict(docs.dtypes)

    def run(batches):
        Runs.empty_all()
        for batch in steps(batches, text_col):
            scores = network.scores(features(strings(batch.column(text_col)))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*kept, score_col])

    return map_batches(docs.select(*kept), run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", `{score_col}` double")


def quality_scores(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted, prior for each row of ``docs``."""
    network, prior = train(docs, labels, positives, unlabelled)
    return with_score(id_and_text(docs), network).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.lit(prior).alias("prior")
    )
