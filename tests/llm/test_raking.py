import hashlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from brute import WORD
from tillwatch.llm import raking

TARGETS = {"source": {"src0": 0.2, "src1": 0.5, "src2": 0.3}, "lang": {"en": 0.5, "fr": 0.25, "de": 0.25}, "topic": {"prose": 0.9, "tabular": 0.1}}


def _plain(rows, keep, seed):
    """The same on single documents: each has a weight that is scaled to one marginal after the other."""
    topic = lambda t: "tabular" if " | " in t else "licensed" if "Licensed under" in t else "contact" if "@" in t or "http" in t else "prose"
    docs = []
    for doc_id, text, source, lang in rows:
        text = text or ""
        keys = [v if v in TARGETS[a] else "other" for a, v in zip(("source", "lang", "topic"), (source, lang, topic(text)))]
        docs.append((doc_id, keys, len(WORD.findall(text))))
    total = sum(n for *_, n in docs)
    wanted = []
    for k, axis in enumerate(("source", "lang", "topic")):
        have = defaultdict(float)
        for _, keys, n in docs:
            have[keys[k]] += n / total
        named = {v: t for v, t in TARGETS[axis].items()}
        scale = (1 - have["other"]) / sum(named.values())
        goal = {v: t * scale for v, t in named.items()} | {"other": have["other"]}
        goal = {v: t for v, t in goal.items() if have[v] > 0}
        wanted.append({v: t / sum(goal.values()) for v, t in goal.items()})
    weight = [n / total for *_, n in docs]
    for _ in range(300):
        for k in range(3):
            now = defaultdict(float)
            for (_, keys, _), w in zip(docs, weight):
                now[keys[k]] += w
            weight = [w * wanted[k][keys[k]] / now[keys[k]] if now[keys[k]] else 0.0 for (_, keys, _), w in zip(docs, weight)]
    ratio = [w * total / n if n else 0.0 for (*_, n), w in zip(docs, weight)]
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(1, mid * r) for (*_, n), r in zip(docs, ratio)) < keep * total else (low, mid)
    out = {}
    for (doc_id, _, n), r in zip(docs, ratio):
        p = min(1, low * r)
        u = int(hashlib.md5(f"{seed}|{doc_id}".encode()).hexdigest()[:12], 16) / 16**12
        out[doc_id] = (n, p, u < p)
    return out


def test_matches_raking_of_single_documents(documents):
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in documents.collect()]
    expected = _plain(rows, 0.4, "s")
    found = raking.mixed(documents, TARGETS, 0.4, seed="s").collect()
    assert len(found) == len(rows)
    for r in found:
        n, p, kept = expected[r.doc_id]
        assert r.n_tokens == n and (n == 0 or abs(r.probability - p) < 1e-5)
        draw = int(hashlib.md5(f"s|{r.doc_id}".encode()).hexdigest()[:12], 16) / 16**12
        assert n == 0 or abs(draw - p) <= 1e-5 or r.kept == kept


def test_weighted_expectation_has_the_marginals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = raking.mixed(docs, raking.TARGETS, 0.5).collect()
    total = sum(r.n_tokens for r in got)
    assert abs(sum(r.n_tokens * r.probability for r in got) / total - 0.5) < 1e-6
    for axis in raking.AXES:
        share = defaultdict(float)
        for r in got:
            share[r[axis]] += r.n_tokens * r.probability * r.weight / (0.5 * total)
        assert all(abs(share[v] - t) < 1e-4 for v, t in raking.TARGETS[axis].items() if share[v])


def test_odd_rows(odd, none):
    got = raking.mixed(odd, raking.TARGETS, 0.5).collect()
    assert len(got) == odd.count() and all(0 <= r.probability <= 1 for r in got)
    assert raking.mixed(none, raking.TARGETS, 0.5).count() == 0
    assert len(raking.mixed(odd, {}, 0.5).collect()) == odd.count()


def test_calibration_fills_up_cells():
    tokens = np.array([100.0, 10.0, 0.0])
    p = raking.calibrate(tokens, np.array([0.5, 0.5, 0.0]), 0.5)
    assert p[1] == 1.0 and abs(100 * p[0] + 10 - 55) < 1e-9


def test_largest_keep_within_the_tolerance():
    rng = np.random.default_rng(1)
    for _ in range(30):
        tokens = rng.integers(0, 1000, (4, 3, 2)).astype(float) ** 2
        shares = raking.rake(tokens, [np.full(n, 1 / n) for n in tokens.shape])

        def worst(keep):
            kept = tokens * raking.calibrate(tokens, shares, keep)
            off = [(1, 2), (0, 2), (0, 1)]
            return max(np.abs(kept.sum(o) / kept.sum() - shares.sum(o)).max() for o in off)

        keep = raking.reachable_keep(tokens, shares, 0.01)
        assert 0 < keep <= 1 and worst(keep) <= 0.01 + 1e-9
        assert all(worst(k) > 0.01 for k in np.linspace(keep, 1, 200)[1:])
    assert raking.reachable_keep(tokens, tokens / tokens.sum()) == 1.0
    assert raking.reachable_keep(np.zeros((2, 2, 2)), np.zeros((2, 2, 2))) == 1.0


def test_floor_and_weights_meet_what_sampling_cannot(spark):
    """One source has a third of all rows, another almost nothing of what it should have."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    hot = F.when(F.col("doc_id") % 3 == 0, "src0").when((F.col("source") == "src5") & (F.pmod(F.xxhash64("doc_id"), F.lit(50)) != 1), "src6")
    docs = docs.withColumn("source", hot.otherwise(F.col("source")))
    assert raking.mixed(docs, raking.TARGETS, None).agg(F.sum(F.col("n_tokens") * F.col("kept").cast("int")) / F.sum("n_tokens")).first()[0] < 0.4
    left = raking.sampled(docs, raking.TARGETS, None, 0.5)
    assert left.columns == docs.columns
    found = {r.doc_id: r.kept for r in raking.mixed(docs, raking.TARGETS, None, 0.5).collect()}
    assert {r.doc_id for r in left.select("doc_id").collect()} == {d for d, k in found.items() if k}
    n = raking.word_count(F.col("text"))
    assert left.agg(F.sum(n)).first()[0] / docs.agg(F.sum(n)).first()[0] > 0.48
    weighted = raking.weights(left, raking.TARGETS)
    share = n.cast("double") * F.col("weight")
    total = weighted.agg(F.sum(share)).first()[0]
    assert abs(total / left.agg(F.sum(n)).first()[0] - 1) < 1e-6
    topic = raking.surface_topic(F.coalesce("text", F.lit("")))
    for axis, column in zip(raking.AXES, (F.col("source"), F.col("lang"), topic)):
        got = {r[0]: r[1] / total for r in weighted.groupBy(column).agg(F.sum(share)).collect()}
        assert all(abs(got[v] - t) < 1e-6 for v, t in raking.TARGETS[axis].items()), (axis, got)
    rows = {(r.axis, r.value): r for r in raking.marginals(docs, raking.TARGETS, None, 0.5).collect()}
    assert abs(rows["source", "src5"].kept - 0.05) > 0.01 and abs(rows["source", "src5"].weighted - 0.05) < 1e-6
    gone = raking.marginals(docs.where("source <> 'src5'"), raking.TARGETS, None, 0.5).where("value = 'src5'").first()
    assert (gone.target, gone.weighted) == (0.05, 0.0)


def test_sampled_and_weights_of_odd_rows(odd, none):
    for keep in (1.0, None):
        left = raking.sampled(odd, raking.TARGETS, keep, 0.5)
        assert left.columns == odd.columns
    assert raking.sampled(odd, raking.TARGETS, 1.0).count() == odd.count()
    assert raking.weights(odd, raking.TARGETS, name="score").columns == [*[c for c in odd.columns if c != "score"], "score"]
    assert raking.sampled(none, raking.TARGETS, None, 0.5).count() == 0 == raking.weights(none, raking.TARGETS).count()
