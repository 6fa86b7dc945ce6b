"""A document table through five stages: quality, exact and near duplicates, mixing, SentencePiece ids.

Each stage takes what its predecessor kept, judges it by its own input, and drops what it rejects; all but the last
return the columns of ``documents``. Every stage reads whole texts.

Whole texts stay where they are wherever that is possible: the classifier and mixing judge a row by itself, and both
dedup stages drop rows by the few that go. Those are broadcast while they are at most ``BROADCAST_ROWS`` (a row is some
dozens of bytes), and beyond that meet the rows in a sort-merge join.

Mixing keeps at least ``FLOOR`` of the tokens. What sampling can't reach at that floor, the last stage's ``weight`` makes up
for: pieces times weight have the target shares.

Defined results: a null text counts as empty; of rows that are the same in id and text, exact dedup leaves one. Of each
group of near duplicates one row stays: the one of the smallest id, and where ids are null or repeat, the one that the
written order has first. Without labels the classifier rejects nothing, and an empty table stays empty. Other columns pass
through unread.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.llm import fuse_dedup, lsh_forest, quality_pu, raking, suffix_pieces
from tillwatch.llm.raking import TARGETS
from tillwatch.llm.texts import SPACE
from tillwatch.session import few_files, hand_off

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: share of tokens that mixing is expected to keep: the largest at which they meet the targets without weights, but at
#: least the floor
KEEP, FLOOR = None, 0.5
#: rows of a side of a join up to which it is broadcast
BROADCAST_ROWS = 500_000


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts; it is fitted on these documents and the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    network, _ = quality_pu.train(docs, labels)
    score = _free(docs, "_score")
    return quality_pu.with_score(docs, network, score_col=score).where(F.col(score) >= 0.5).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    batch = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(3)), F.lit(0))
    digest, rid = _free(docs, "_sha"), _free(docs, "_id")
    found = fuse_dedup.exact_dedup(docs, batch).select(F.col("doc_id").alias(rid), F.col("text_sha256").alias(f"{digest}k"), "kept")
    # of each id and text whether its rows go, or stay as one of several that are the same
    seen = found.groupBy(rid, f"{digest}k").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    seen = hand_off(few_files(seen.where("NOT kept OR n > 1")), "exact-marked")
    rows = docs.withColumn(digest, F.sha2(F.translate(F.coalesce("text", F.lit("")), SPACE, ""), 256))
    same = lambda side: rows["doc_id"].eqNullSafe(side[rid]) & (rows[digest] == side[f"{digest}k"])
    marked = _sized(seen.drop("kept", "n"))
    left = rows.join(marked, same(marked), "left_anti")
    several = _sized(seen.where("kept").drop("kept", "n"))
    single = rows.join(several, same(several), "left_semi").dropDuplicates(["doc_id", digest])
    return left.unionByName(single).drop(digest)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, 80 % alike."""
    if docs.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").isEmpty():
        return _without(docs, lsh_forest.near_groups(docs, percent=80).where("NOT kept").select("doc_id"), "doc_id")
    rid = _free(docs, "_row")
    rows = hand_off(docs.withColumn(rid, F.monotonically_increasing_id()), "near-rows")
    gone = lsh_forest.near_groups(rows, percent=80, id_col=rid).where("NOT kept").select("doc_id")
    return _without(rows, gone, rid).drop(rid)


def _sized(side: DataFrame) -> DataFrame:
    """A written table as one side of a join: broadcast while it is small, merged where it isn't."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side.hint("merge")


def _without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id, which no other row has, is not among those that go."""
    ids = _sized(hand_off(few_files(gone.select(F.col("doc_id").alias("_gone"))), "gone"))
    return docs.join(ids, docs[id_col] == ids["_gone"], "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by calibrated probabilities, so that kept tokens are as near the target shares as ``FLOOR`` lets them."""
    return raking.sampled(docs, TARGETS, KEEP, FLOOR)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip (whether the ids decode to the text), ids, and weight.

    ``weight`` is taken from the rows of this stage alone: their tokens times weight have the target shares.
    """
    return suffix_pieces.round_trips(raking.weights(docs, TARGETS, name="weight"), PIECES, carry="weight")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", pieces),
]
#: model fits, hashed signatures and tokenizers have no SQL; tests compare the stages with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = hand_off(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return docs
