import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

import brute
from tillwatch import session
from tillwatch.llm import fuse_dedup, lsh_forest

COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def _found(df, percent):
    return sorted((tuple(r) for r in lsh_forest.near_groups(df, percent).select(*COLUMNS).collect()), key=repr)


def _varied(seed, base_words, copies, edits):
    """Copies of one text with ``edits`` words replaced each."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(base_words)]
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randint(*edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_matches_brute_force(spark, percent):
    # groups whose members are just above and just below the threshold, and unlike texts
    texts = _varied(1, 300, 25, (0, 6)) + _varied(2, 120, 12, (1, 3)) + _varied(3, 200, 20, (2, 9)) + _varied(4, 40, 6, (0, 1))
    rows = list(enumerate(texts + [f"a{i} b c d e f{i}" for i in range(20)]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert _found(df, percent) == sorted(brute.near_components(rows, percent), key=repr)


def test_documents_match_brute_force(documents, rows):
    assert _found(documents, 85) == sorted(brute.near_components(rows, 85), key=repr)


def test_small_tables_are_few_files(spark, documents, tmp_path, monkeypatch):
    cores, rows = spark.sparkContext.defaultParallelism, _found(documents, 80)
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    wide = {"spark.sql.shuffle.partitions": str(5 * cores), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    usual = {k: spark.conf.get(k) for k in wide}
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        assert _found(documents, 80) == rows
        assert fuse_dedup.exact_dedup(documents, F.pmod("doc_id", F.lit(3))).count() == documents.count()
        spread = documents.repartition(5 * cores, "doc_id")
        assert session.few_files(spread).rdd.getNumPartitions() == cores
        assert session.few_files(spread, 1000).rdd.getNumPartitions() == 5 * cores
        assert session.few_files(spark.range(9).repartition(5 * cores, "id")).rdd.getNumPartitions() == 5 * cores
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    files = Counter(p.parent for p in tmp_path.rglob("part-*"))
    assert len(files) > 10 and max(files.values()) <= cores


def test_odd_rows(odd, none):
    rows = {r.doc_id: r.text for r in odd.collect()}
    expected = {r[0]: r for r in brute.near_components(list(rows.items()), 85)}
    found = _found(odd, 85)
    assert len(found) == odd.count()  # repeated rows give a row each
    assert all(expected[r[0]] == r for r in found)
    assert lsh_forest.near_groups(none, 85).count() == 0


def test_null_ids(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "q r s t u v")]
    found = lsh_forest.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in found), key=repr) == [
        (4, 4, True), (None, 4, False), (None, None, True),
    ]


def test_squares_of_a_large_region_lose_nothing(spark):
    texts = _varied(5, 150, 30, (0, 5))
    sets = [np.array(sorted({hash(x) & (2**63 - 1) for x in brute.shingles(t)}), np.uint64) for t in texts]
    names = [bytes([i]) * 4 for i in range(len(texts))]
    region = spark.createDataFrame([(1, bytearray(c)) for c in names], "key long, cls binary")
    held = spark.createDataFrame([(bytearray(c), bytearray(s.tobytes())) for c, s in zip(names, sets)], "cls binary, set binary")
    none = spark.createDataFrame([], "node binary, root binary")
    groups = []
    for block in (4, 1000):
        links = lsh_forest.crossing_links(lsh_forest.open_regions(region, none, block), held, 85)
        made = lsh_forest.components(links).collect()
        groups.append({bytes(r.node): bytes(r.root) for r in made})
    expected = brute.near_components([(i, t) for i, t in enumerate(texts)], 85)
    assert groups[0] == groups[1]
    assert {names[d]: names[c] for d, _, c, _ in expected if names[d] in groups[0]} == groups[0]
    assert sum(c != d for d, _, c, _ in expected) == sum(k != v for k, v in groups[0].items())


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    links = [(bytearray([x // 256, x % 256]), bytearray([y // 256, y % 256])) for x, y in zip(order, order[1:])]
    got = lsh_forest.components(spark.createDataFrame(links, "a binary, b binary")).collect()
    assert len(got) == 200 and {bytes(r.root) for r in got} == {bytes([0, 0])}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    for same in (0.3, 0.6, 0.9):
        got = []
        for _ in range(40):
            pool = rng.integers(0, 2**63, 2000, dtype=np.uint64)
            n = int(1000 * same)
            a, b = np.concatenate([pool[:n], pool[1000 : 2000 - n]]), np.concatenate([pool[:n], pool[2000 - (1000 - n) :]])
            union = len(np.union1d(a, b))
            got.append((lsh_forest.signature(a) == lsh_forest.signature(b)).mean() - len(np.intersect1d(a, b)) / union)
        assert abs(np.mean(got)) < 0.03
