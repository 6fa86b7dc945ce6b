"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number in (0, 1) for a key, by a digest of both; the key goes to the shard of least ``-ln(draw) /
weight``. That is an exponential race, which a shard wins in proportion to its weight. A draw depends on the key and its
own shard alone, so another shard, or more weight for one, takes keys only into itself and moves nothing else. The law of
the registered query is ``key``: key and shards decide. Sizes are then near equal only as far as keys are many, and rows
with equal texts stay together only if their keys are equal; neither is promised.

A shard's rows have gapless slots from 0. No task sorts a shard: rows are counted by (shard, bucket), a bucket being a
range of digests, as many as make buckets of about ``BUCKET`` rows; the sums before each bucket are the first slots, and rows
are numbered inside a bucket. Rows that agree in all that is returned can't be told apart and are one row with a count up
to the end, so a key or a text that a third of all rows have is no large bucket either. Only the counts of buckets, one row
for ``BUCKET`` rows, meet by shard. Slots follow the order of digests: they depend on the rows alone, neither on
partitions nor on their order.

Defined results: a null key is a key of its own, the same for all such rows, as the law has it; null texts have no bytes
and count as empty; repeated rows have slots of their own; ties between shards (equal draws) go to the lowest number;
empty tables give no rows; other columns are ignored, whatever their names. Texts of any length are read whole, once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tillwatch.session import HandOffs

SHARDS = (1.0,) * 8
#: rows that a bucket is meant to have; and rows that one counted row is spread to at once
BUCKET, RUN = 50_000, 10_000
#: of a digest, the hexadecimal digits that are a draw: 48 bits, exact as a double
DIGITS = 12
#: hexadecimal digits of the digest that rows of a shard are ordered by
PLACE = 15


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that depends on the key and the shard alone."""
    digest = F.md5(F.concat(key, F.lit(f"|{shard}")))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that ``key`` goes to; ``weights`` has a positive number for each shard, or 0 for one left out."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights are positive, or 0 for a shard that takes nothing")
    key = F.coalesce(key.cast("string"), F.lit("null"))
    races = [
        F.struct((-F.ln(draw(key, s)) / F.lit(float(w))).alias("time"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    return (F.least(*races) if len(races) > 1 else races[0])["shard"]


def placed(docs: DataFrame, weights: Sequence[float] = SHARDS, key_col: str = "doc_id") -> DataFrame:
    """The columns of ``docs`` and ``shard``; a column of that name is replaced."""
    return docs.withColumn("shard", shard_of(F.col(key_col), weights))


def shards(
    docs: DataFrame,
    weights: Sequence[float] = SHARDS,
    added: float = 1.0,
    bucket: int = BUCKET,
    id_col: str = "doc_id",
    text_col: str = "text",
    held: HandOffs | None = None,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (with one more shard of weight ``added``) of each row."""
    held = held or HandOffs()
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # what is returned is all that tells rows apart; map-side sums first
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    place = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "size", "text_crc32"))
    rows = rows.select(
        "*",
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), [*weights, added]).alias("grown_shard"),
        F.conv(F.substring(place, 1, PLACE), 16, 10).cast("long").alias("place"),
    )
    rows = held.write(rows, "shard-rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // (bucket * max(1, len(weights)))))
    rows = rows.withColumn("bucket", F.floor(F.col("place") / F.lit(float(16**PLACE)) * F.lit(buckets)).cast("long"))
    counts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket").orderBy("place", "doc_id", "size", "text_crc32")
    numbered = rows.withColumn("slot", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    numbered = numbered.join(first, ["shard", "bucket"]).withColumn("slot", F.col("slot") + F.col("first"))
    # a counted row is spread in runs, so that one of any count is neither one array nor one task
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN).cast("long"))).alias("run")
    numbered = numbered.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "slot", "n", runs)
    left = F.least(F.col("n") - F.col("run") * RUN, F.lit(RUN).cast("long"))
    one = F.explode(F.sequence(F.lit(0).cast("long"), left - 1)).alias("one")
    many = numbered.repartition("shard", "slot", "run")
    return many.select("*", one).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col("run") * RUN + F.col("one")).alias("slot"), "grown_shard"
    )
