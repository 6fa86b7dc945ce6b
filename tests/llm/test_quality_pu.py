import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brute import ODD_TEXTS
from tillwatch.llm import quality_pu, texts
from tillwatch.llm.texts import Runs

FOLDER = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    got = quality_pu.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.predicted for r in got if r.quality == 1], [r.predicted for r in got if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.2
    share = len(good) / len(got)
    assert abs(got[0].prior - share) < 0.05


def test_held_out_labels_teach_nothing(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_pu.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [sorted((r.doc_id, r.score) for r in quality_pu.quality_scores(documents, x).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (6, 1), (7, 1), (8, 0), (7, 0), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality_pu.quality_scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in quality_pu.quality_scores(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_pu.quality_scores(none, labels).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = pa.array([t or "" for t in ODD_TEXTS])
    whole = quality_pu.features(texts)
    for i in range(len(texts)):
        assert np.array_equal(whole[i : i + 1], quality_pu.features(pa.concat_arrays([texts.slice(i, 1)])))


def test_features_hold_a_slice_at_a_time():
    texts = pa.array(["Some plain words, and 12 numbers.\n" * 300] * 400)
    assert texts.nbytes > 4_000_000
    quality_pu.features(texts.slice(0, 1))
    tracemalloc.start()
    found = quality_pu.features(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000 and (found == found[0]).all()


def test_tables_of_other_stages_are_emptied():
    tables = [Runs(lambda ws: [[len(w)] for w in ws]) for _ in range(2)]
    assert tables[0].rows_of(["a", "bcd"]).tolist() == [0, 1]
    Runs.empty_all()
    assert not tables[0].rows and not tables[1].rows
    assert tables[0].expand(np.array([0, 1]), ["bcd", "a"])[0].tolist() == [3, 1]


def test_workers_hand_memory_back(spark, monkeypatch):
    class Frame:
        sparkSession = spark

        def mapInArrow(self, fn, schema):
            return list(fn(iter([1, 2])))

    called = []
    monkeypatch.setattr(texts, "hand_back", lambda: called.append(1))
    assert texts.map_batches(Frame(), lambda batches: (2 * b for b in batches), "n long") == [2, 4] and len(called) == 1
    one, other = (Runs(lambda ws: [[len(w)] for w in ws]) for _ in range(2))
    other.rows_of(["a"])
    one.alone()
    assert not other.rows and len(called) == 2
    Runs.empty_all()
    assert len(called) == 3


def test_risk_is_corrected_below_zero():
    rng = np.random.default_rng(1)
    positive = rng.normal(1, 1, (400, 5)).astype(np.float32)
    unlabelled = np.concatenate([rng.normal(1, 1, (600, 5)), rng.normal(-1.5, 1, (400, 5))]).astype(np.float32)
    prior = quality_pu.estimate_prior(positive, unlabelled)
    assert 0.5 < prior < 0.75
    network = quality_pu.fit(positive, unlabelled, prior)
    assert (network.scores(unlabelled[:600]) >= 0.5).mean() > 0.9 and (network.scores(unlabelled[600:]) >= 0.5).mean() < 0.15
