import brute
from tillwatch.llm.ngram_rules import quality_rules

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_counts_match_brute_force(spark, documents, rows):
    found = {r.doc_id: tuple(r[c] for c in BASE) for r in quality_rules(documents, _labels(spark)).collect()}
    assert found == {d: brute.base_counts(t) for d, t in rows}


def test_odd_rows(spark, odd, none):
    got = quality_rules(odd, _labels(spark)).collect()
    assert sorted((r.doc_id, *(r[c] for c in BASE)) for r in got) == sorted((r.doc_id, *brute.base_counts(r.text)) for r in odd.collect())
    assert not any(r.kept for r in got if r.base_failed)
    assert quality_rules(none, _labels(spark)).count() == 0
    assert quality_rules(odd, _labels(spark).limit(0)).where("kept = base_failed").count() == 0


def test_score_is_the_mean_ratio_whatever_the_partitions(spark, documents):
    a = {r.doc_id: (r.llr, r.kept) for r in quality_rules(documents, _labels(spark)).collect()}
    b = {r.doc_id: (r.llr, r.kept) for r in quality_rules(documents.repartition(7), _labels(spark)).collect()}
    assert a == b


def test_keeps_good_documents_and_drops_most_bad_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = quality_rules(docs, _labels(spark)).join(_labels(spark), "doc_id").where("NOT base_failed").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.5 * len(bad)
