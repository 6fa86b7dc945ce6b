import hashlib

from pyspark.sql import functions as F

from checks.compare import connect, differences
from tillwatch.llm import lang_fusion, queries, warc_merkle

FOLDER = "/root/testdata/sf0.001"


def _pages(spark):
    return spark.read.parquet(f"{FOLDER}/pages.parquet")


def _shard():
    return F.coalesce(F.expr("page_id div 32"), F.lit(-1))


def test_audit_matches_sql(spark):
    assert differences(queries.QUERIES["op2_merkle_fixity_audit"](spark, FOLDER), connect(FOLDER), queries.SQL["op2_merkle_fixity_audit"]) == []


def test_equal_replicas_have_equal_roots_and_no_differences(spark):
    m = warc_merkle.manifest(_pages(spark), _shard())
    again = warc_merkle.manifest(_pages(spark).repartition(5), _shard())
    assert warc_merkle.roots(m).collect() == warc_merkle.roots(again).collect()
    assert warc_merkle.audit(m, again).count() == 0


def test_changed_missing_and_extra_records(spark):
    pages = _pages(spark)
    m = warc_merkle.manifest(pages, _shard())
    one = m.orderBy("page_id").offset(7).limit(1).collect()[0]
    lost = m.where(F.col("page_id") != one.page_id)  # the file keeps its gap
    assert [(r.page_id, r.kind) for r in warc_merkle.audit(m, lost).collect()] == [(one.page_id, "missing")]
    assert [(r.page_id, r.kind) for r in warc_merkle.audit(lost, m).collect()] == [(one.page_id, "extra")]
    bad = m.withColumn("sha", F.when(F.col("page_id") == one.page_id, F.sha2("sha", 256)).otherwise(F.col("sha")))
    assert [(r.page_id, r.kind, r.offset) for r in warc_merkle.audit(m, bad).collect()] == [(one.page_id, "changed", one.offset)]
    assert warc_merkle.roots(m).collect() != warc_merkle.roots(bad).collect()


def test_odd_pages(spark):
    rows = [(1, None, None, 1), (None, "u", "h", 2), (1, None, None, 3), (2, "http://x.example.org/a", "<p>é</p>", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, sha int")
    m = warc_merkle.manifest(df, _shard())
    assert m.count() == 4
    assert warc_merkle.audit(m, m).count() == 0
    assert warc_merkle.audit(m, m.limit(0)).where("kind = 'missing'").count() == 4
    assert warc_merkle.audit(m.limit(0), m.limit(0)).count() == 0


def test_languages_of_pages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = lang_fusion.page_languages(pages, docs).join(pages, "page_id")
    told = got.withColumn("doc_id", F.regexp_extract("url", r"://[^/]+/[a-z]+/(\d+)", 1).cast("long"))
    told = told.join(docs.select("doc_id", F.col("lang").alias("wanted")), "doc_id").collect()
    assert len(told) > 200
    assert sum(r.lang == r.wanted for r in told) >= 0.98 * len(told)
    assert all(0 < r.confidence <= 1 for r in told)


def test_evidence_decides_what_the_text_leaves_open(spark):
    docs = spark.createDataFrame([("the and of with", "en"), ("der die das und", "de"), (None, "de"), ("x", None)], "text string, lang string")
    said = [(i, f"http://h{i}.example.de/", f"<html lang='de'><p>der die das und {i}</p>") for i in range(30)]
    said += [(100 + i, f"http://g{i}.example.com/", f"<html lang='en'><p>the and of with {i}</p>") for i in range(30)]
    rows = said + [(900, "http://h3.example.de/q", "<html lang=de><p>42</p>"), (901, None, None), (900, "http://h3.example.de/q", "<html lang=de><p>42</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("?")).withColumn("host", F.lit(1))
    got = lang_fusion.page_languages(pages, docs).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[900].lang == "de" and by[900].confidence > 0.8 and by[901].lang in ("de", "en")
    assert all(by[i].lang == "de" and by[100 + i].lang == "en" for i in range(30))
    assert lang_fusion.page_languages(pages.limit(0), docs).count() == 0
    assert {r.lang for r in lang_fusion.page_languages(pages, docs.limit(0)).collect()} == {None}


def test_every_language_of_the_documents_is_a_candidate(spark):
    word = lambda i, j: hashlib.md5(f"{i} {j}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))
    text = [" ".join(word(i, j) for j in range(6)) for i in range(lang_fusion.BLOCK + 44)]
    docs = [(t, f"l{i:03}") for i, t in enumerate(text) for _ in range(1 + (i < 64))]
    docs = spark.createDataFrame(docs, "text string, lang string")
    pages = [(i, f"http://h{i}.example.com/", f"<p>{t}</p>") for i, t in enumerate(text)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = lang_fusion.page_languages(pages, docs).collect()
    assert len(got) == len(text) and all(r.lang == r.text_lang == f"l{r.page_id:03}" for r in got)
