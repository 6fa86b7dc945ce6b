"""The queries of this package by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tillwatch.llm import (
    fuse_dedup, lang_fusion, lsh_forest, ngram_rules, quality_pu, raking, rendezvous, resync, spelling, suffix_pieces,
    token_links, warc_merkle, wavelet,
)

Query = Callable[[SparkSession, str], DataFrame]
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_positive_unlabelled_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores of all documents, learnt from positive labels outside the held-out third."""
    return quality_pu.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op2_merkle_fixity_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Records in which a replica of the pages' WARC shards differs from the first one.

    The replica is derived from the same pages by a rule that stands for bit rot: pages whose id leaves 13 by 97 have
    each "e" of their html read as "c". A shard holds 512 page ids.
    """
    pages = _table(spark, folder, "pages")
    shard = F.coalesce(F.expr("page_id div 512"), F.lit(-1))
    rotten = F.when(F.pmod("page_id", F.lit(97)) == 13, F.translate("html", "e", "c")).otherwise(F.col("html"))
    return warc_merkle.audit(warc_merkle.manifest(pages, shard), warc_merkle.manifest(pages, shard, rotten))


def op3_suffix_array_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """SentencePiece ids of each document as a digest, and whether they decode to its text."""
    return suffix_pieces.round_trips(_table(spark, folder, "documents"), PIECE_BPE, with_ids=False)


def op4_fuse_filter_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Exact groups of documents that arrive in three batches, the first two of them snapshots."""
    batch = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(3)), F.lit(0))
    return fuse_dedup.exact_dedup(_table(spark, folder, "documents"), batch).drop("batch")


def op5_evidence_fusion_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Language of each page by text, markup, address suffix and host."""
    return lang_fusion.page_languages(_table(spark, folder, "pages"), _table(spark, folder, "documents"))


def op6_ngram_ratio_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rules and the hashed n-gram verdict for each document."""
    return ngram_rules.quality_rules(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op7_raked_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Documents sampled to source, language and topic marginals; half of all tokens are expected to stay."""
    return raking.mixed(_table(spark, folder, "documents"), raking.TARGETS, keep=0.5)


def op8_wavelet_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as read back from wavelet-matrix shard files."""
    return wavelet.token_shards(spark, _table(spark, folder, "documents"), BYTE_BPE, end_id=2)


def op9_overlap_resync_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of each document, huge ones by spliced chunks."""
    return resync.token_counts(_table(spark, folder, "documents"), WORD_BPE, limit=2048)


def op10_lsh_forest_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of five-word shingles are 85 % alike."""
    return lsh_forest.near_groups(_table(spark, folder, "documents"), percent=85).drop("set_digest")


def op11_incidence_token_links(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens, groups and links of two tokenizers for each document."""
    return token_links.aligned(_table(spark, folder, "documents"), BYTE_BPE, PIECE_BPE)


def op12_composed_spelling_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Words, their near words and the form that each belongs to."""
    return spelling.spelling_forms(_table(spark, folder, "documents"))


def op13_rendezvous_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of each document in eight shards of equal weight, and its shard among nine."""
    return rendezvous.shards(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    "op1_positive_unlabelled_quality": op1_positive_unlabelled_quality,
    "op2_merkle_fixity_audit": op2_merkle_fixity_audit,
    "op3_suffix_array_pieces": op3_suffix_array_pieces,
    "op4_fuse_filter_dedup": op4_fuse_filter_dedup,
    "op5_evidence_fusion_languages": op5_evidence_fusion_languages,
    "op6_ngram_ratio_rules": op6_ngram_ratio_rules,
    "op7_raked_mixture": op7_raked_mixture,
    "op8_wavelet_shards": op8_wavelet_shards,
    "op9_overlap_resync_counts": op9_overlap_resync_counts,
    "op10_lsh_forest_groups": op10_lsh_forest_groups,
    "op11_incidence_token_links": op11_incidence_token_links,
    "op12_composed_spelling_forms": op12_composed_spelling_forms,
    "op13_rendezvous_shards": op13_rendezvous_shards,
    "pipeline": corpus_pipeline.run,
}

EXACT_SQL = """
WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256,
        length(coalesce(text, '')) AS size
    FROM documents
)
SELECT doc_id, text_sha256,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY size DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size,
    doc_id IS NOT DISTINCT FROM keep_id AS kept
FROM d
"""

AUDIT_SQL = """
WITH p AS (
    SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, url AS raw_url,
        coalesce(page_id // 512, -1) AS shard
    FROM pages
), r AS (
    SELECT shard, page_id, raw_url, url, html,
        CASE WHEN page_id % 97 = 13 THEN translate(html, 'e', 'c') ELSE html END AS other
    FROM p
), w AS (
    SELECT shard, page_id, raw_url,
        concat('WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:', page_id, '>\r\nWARC-Target-URI: ', url,
            '\r\nContent-Type: text/html\r\nContent-Length: ', strlen(html), '\r\n\r\n', html, '\r\n\r\n') AS a,
        concat('WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:', page_id, '>\r\nWARC-Target-URI: ', url,
            '\r\nContent-Type: text/html\r\nContent-Length: ', strlen(other), '\r\n\r\n', other, '\r\n\r\n') AS b
    FROM r
), m AS (
    SELECT shard, page_id, strlen(a) AS size_a, strlen(b) AS size_b, sha256(a) AS sha_a, sha256(b) AS sha_b,
        CAST(coalesce(sum(strlen(a)) OVER (
            PARTITION BY shard ORDER BY page_id NULLS FIRST, raw_url NULLS FIRST, sha256(a)
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
    FROM w
)
SELECT shard, "offset", page_id, 'changed' AS kind, size_a, size_b, sha_a, sha_b FROM m WHERE sha_a <> sha_b
"""

NEAR_SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'
    ), lambda x: x <> '') AS words
    FROM documents
), p AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w
), f AS (
    SELECT doc_id, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d, lead(word, 4) OVER o AS e
    FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), g AS (
    SELECT DISTINCT doc_id, concat_ws(' ', word, b, c, d, e) AS s FROM f WHERE e IS NOT NULL
    UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM w WHERE len(words) BETWEEN 1 AND 4
), e AS (
    SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id) AS n FROM g
), l AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), r AS (
    SELECT doc_id, doc_id AS seen FROM w UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.seen = l.x
), c AS (
    SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id
)
SELECT doc_id, coalesce(t.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) t USING (doc_id)
"""

#: crc32 by a table of its 256 steps, over lists of bytes
CRC_SQL = """steps AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step
)"""


def _crc(data: str) -> str:
    """SQL for the unsigned crc32 of a list of bytes; ``step`` is in scope."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}::BIGINT[]), "
        "lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295)"
    )


FORMS_SQL = f"""
WITH RECURSIVE {CRC_SQL}, runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents
), distinct_runs AS (
    SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
), digests AS (
    SELECT run, n, {_crc("""flatten(list_transform(
        string_split(concat(doc_id, ':', run), ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END))""")} AS h
    FROM distinct_runs, steps
), results AS (
    SELECT CASE WHEN h % 199 = 0 THEN concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n
    FROM digests
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), gaps AS (
    SELECT word, n, i, concat(left(word, i), substr(word, i + 2)) AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON g.rest = w.word
    UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON g.rest = w.word
), best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n
    FROM near GROUP BY word
), forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 5 * w.n THEN b.other END AS form,
        CASE WHEN b.other_n >= 5 * w.n THEN b.other_n END AS form_n
    FROM words w LEFT JOIN best b USING (word)
), chains AS (
    SELECT word, word AS at, 0 AS k FROM forms
    UNION ALL SELECT c.word, f.form, k + 1 FROM chains c JOIN forms f ON c.at = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, (SELECT arg_max(c.at, c.k) FROM chains c WHERE c.word = f.word) AS root, f.n, f.n_near, f.form_n FROM forms f
"""


def _draws(shards: int) -> str:
    """SQL for the shard of the shortest race among equal weights: the one of the largest draw, the lowest among equals."""
    return (
        f"list_reduce(list_transform(range({shards}), lambda s: {{'d': ('0x' || left(md5(concat(doc_id, '|', s)), 12))::BIGINT, 's': s}}), "
        "lambda x, y: CASE WHEN y.d > x.d THEN y ELSE x END).s"
    )


SHARDS_SQL = f"""
WITH {CRC_SQL}, sized AS (
    SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS data
    FROM documents
), races AS (
    SELECT *, {_draws(8)} AS shard, {_draws(9)} AS grown_shard FROM sized
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard,
    row_number() OVER (PARTITION BY shard ORDER BY left(md5(concat(doc_id, '|', size, '|', text_crc32)), 15), doc_id) - 1 AS slot
FROM (SELECT *, {_crc("data")} AS text_crc32 FROM races, steps)
"""

SQL: dict[str, str] = {
    "op2_merkle_fixity_audit": AUDIT_SQL,
    "op4_fuse_filter_dedup": EXACT_SQL,
    "op10_lsh_forest_groups": NEAR_SQL,
    "op12_composed_spelling_forms": FORMS_SQL,
    "op13_rendezvous_shards": SHARDS_SQL,
}
