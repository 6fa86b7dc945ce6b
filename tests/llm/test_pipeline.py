import corpus_pipeline
import sentencepiece
from pyspark.sql import functions as F

import brute
from tillwatch.llm import raking

FOLDER = "/root/testdata/sf0.001"


def test_stages_are_named_and_keep_columns(spark, documents):
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mixing", "pieces"]
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, documents, FOLDER).columns == documents.columns


def test_stages_against_plain_versions(spark, documents, rows):
    texts = dict(rows)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    exact = corpus_pipeline.exact(spark, documents, FOLDER)
    assert ids(exact) == sorted(r[0] for r in brute.exact_groups(rows) if r[3])
    near = corpus_pipeline.near(spark, exact, FOLDER)
    left = [(d, texts[d]) for d in ids(exact)]
    assert ids(near) == sorted(r[0] for r in brute.near_components(left, 80) if r[3])
    mixed = corpus_pipeline.mixing(spark, near, FOLDER)
    assert ids(mixed) == ids(raking.mixed(near, raking.TARGETS, corpus_pipeline.KEEP, corpus_pipeline.FLOOR).where("kept"))
    model = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.PIECES)
    assert all(r.ids == model.encode(texts[r.doc_id]) and r.weight >= 0 for r in corpus_pipeline.pieces(spark, mixed, FOLDER).collect())
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in corpus_pipeline.pieces(spark, mixed, FOLDER).collect())


def test_run_is_its_stages(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert 0 < out.count() <= 200 and out.select("doc_id").distinct().count() == out.count()


def test_odd_rows(spark, odd, none):
    labels = FOLDER
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, labels).count() == 0
    left = corpus_pipeline.exact(spark, odd, labels).select("doc_id", "text").collect()
    assert len(left) == len({brute.SPACE.sub("", t or "") for t in brute.ODD_TEXTS})
    assert corpus_pipeline.exact(spark, odd, labels).columns == odd.columns
    assert corpus_pipeline.near(spark, odd.where(F.col("doc_id") != 100), labels).columns == odd.columns


def test_null_and_repeated_ids(spark):
    """Each near group and each text leaves one row, whoever shares an id with it."""
    a = " ".join(f"word{i}" for i in range(60))
    b = " ".join(f"other{i}" for i in range(60))
    rows = [(None, a), (None, a + " more"), (None, b), (5, b + " more"), (5, "short text of its own"), (5, "short text of its own"),
            (7, "short  text of its own"), (None, ""), (None, None), (None, " "), (9, "last one here alone now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    exact = corpus_pipeline.exact(spark, docs, FOLDER)
    left = [(r.doc_id, brute.SPACE.sub("", r.text or "")) for r in exact.collect()]
    assert len(left) == len(set(t for _, t in left)) == len({brute.SPACE.sub("", t or "") for _, t in rows})
    near = [r.text or "" for r in corpus_pipeline.near(spark, exact, FOLDER).collect()]
    kinds = sorted("a" if t.startswith("word0") else "b" if t.startswith("other0") else t.strip()[:5] for t in near)
    assert kinds == ["", "a", "b", "last ", "short"]


def test_large_sides_are_merged(spark, documents, monkeypatch):
    small = sorted(r.doc_id for r in corpus_pipeline.near(spark, corpus_pipeline.exact(spark, documents, FOLDER), FOLDER).collect())
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", -1)
    exact = corpus_pipeline.exact(spark, documents, FOLDER)
    assert "BroadcastHashJoin" not in exact._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, exact, FOLDER).collect()) == small


def test_mixing_meets_the_targets_with_a_hot_source(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "src0").otherwise(F.col("source")))
    left = corpus_pipeline.mixing(spark, docs, FOLDER)
    n = raking.word_count(F.col("text"))
    assert left.agg(F.sum(n)).first()[0] > 0.45 * docs.agg(F.sum(n)).first()[0]
    out = corpus_pipeline.pieces(spark, left, FOLDER).select("doc_id", "weight").join(left, "doc_id")
    share = n.cast("double") * F.col("weight")
    topic, total = raking.surface_topic(F.coalesce("text", F.lit(""))), out.agg(F.sum(share)).first()[0]
    for axis, column in zip(raking.AXES, (F.col("source"), F.col("lang"), topic)):
        kept = {r[0]: r[1] / total for r in out.groupBy(column).agg(F.sum(share)).collect()}
        assert all(abs(kept[v] - t) < 1e-6 for v, t in raking.TARGETS[axis].items()), (axis, kept)
