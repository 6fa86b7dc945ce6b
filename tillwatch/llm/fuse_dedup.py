"""Exact deduplication of batches against immutable snapshots, screened by static binary-fuse filters.

Texts are equal when identical without the white space ``[\\x20\\x09-\\x0D]``. Batches arrive in order. Inside a batch,
equal digests are grouped on their own, map-side first. When a batch is in, it is an immutable snapshot: its distinct
digests are dealt to buckets of bounded size and each bucket gets a static 3-wise binary-fuse filter (about 18 bits a
digest). The digests of a later batch are screened by the filters of all snapshots before it; only positives meet the
exact buckets, where the digest is looked up and the bytes of both texts are compared. What is found equal is one group
over all batches.

Defined results: null texts count as empty, so all null and empty texts are one group; of equal texts the row with the
most code points stays, then the smallest ``doc_id``, a null ``doc_id`` last; every row gives a row; repeated rows (same
id and text) are equal to each other and are all kept or all dropped, as ``kept`` is ``doc_id = keep_id``; empty tables
give no rows; other columns are ignored. A text of any length is digested whole. One group may hold any share of the
rows: it is one row a batch before anything is joined, and the last join is on rows of fixed size without texts.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.texts import SPACE, id_and_text, importable
from tillwatch.session import few_files, hand_off

#: digests that one filter is built for, on average
BUCKET = 8_192
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit keys, well mixed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return x ^ (x >> np.uint64(33))


class BinaryFuse:
    """Static set of 64-bit keys: no false negatives, false positives at 2^-16."""

    def __init__(self, seed: int, segment: int, segments: int, prints: np.ndarray):
        self.seed, self.segment, self.segments, self.prints = seed, segment, segments, prints

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """The three places of each key: one in each of three neighbouring segments."""
        span, mask = np.uint64(self.segments * self.segment), np.uint64(self.segment - 1)
        first = (h >> np.uint64(32)) * span >> np.uint64(32)
        second = (first + np.uint64(self.segment)) ^ (h >> np.uint64(18) & mask)
        third = (first + np.uint64(2 * self.segment)) ^ (h & mask)
        return np.stack([first, second, third]).astype(np.int64)

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> np.uint64(32))).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> "BinaryFuse":
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        segment = 1 << max(2, min(18, int(log(max(n, 2)) / log(3.33) + 2.25)))
        room = max(1.125, 0.875 + 0.25 * log(1e6) / log(max(n, 2)))
        for seed in range(1000):
            segments = max(1, ceil(n * (room + 0.02 * (seed // 8)) / segment) - 2)
            made = cls(seed, segment, segments, np.zeros((segments + 2) * segment, np.uint16))
            if made._fill(mixed(keys, seed)):
                return made
        raise ValueError("no filter found")

    def _fill(self, h: np.ndarray) -> bool:
        """Peels places that one key alone has, round by round, and sets the prints in the opposite order."""
        slots, m = self._slots(h), len(self.prints)
        count = np.bincount(slots.ravel(), minlength=m)
        owner = np.zeros(m, np.int64)  # xor of the keys at a place: the key itself where there is one
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(len(h)))
        rounds, left = [], len(h)
        lone = np.flatnonzero(count == 1)
        while len(lone):
            keys, first = np.unique(owner[lone], return_index=True)
            rounds.append((keys, lone[first]))
            left -= len(keys)
            touched = slots[:, keys]
            for row in touched:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(owner, row, keys)
            again = np.unique(touched)
            lone = again[count[again] == 1]
        if left:
            return False
        prints = self._print(h)
        for keys, at in reversed(rounds):
            # the place itself still holds 0, so all three may be taken together
            a, b, c = self.prints[slots[:, keys]]
            self.prints[at] = prints[keys] ^ a ^ b ^ c
        return True

    def __contains__(self, key: int) -> bool:
        return bool(self.contains(np.array([key], np.uint64))[0])

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = mixed(keys, self.seed)
        a, b, c = self.prints[self._slots(h)]
        return self._print(h) == a ^ b ^ c


def _keyed(classes: DataFrame, buckets: int) -> DataFrame:
    return classes.withColumns({"key": F.xxhash64("digest"), "bucket": F.pmod(F.hash("digest"), F.lit(buckets))})


def snapshot_filters(classes: DataFrame, buckets: int) -> DataFrame:
    """One filter for each (batch, bucket) of the distinct digests: snapshot, bucket, seed, segment, segments, prints."""
    importable(classes.sparkSession)

    def build(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = BinaryFuse.build(rows["key"].to_numpy().view(np.uint64))
        return pd.DataFrame(
            [(keys[0], keys[1], made.seed, made.segment, made.segments, made.prints.tobytes())],
            columns=["snapshot", "bucket", "seed", "segment", "segments", "prints"],
        )

    keyed = _keyed(classes, buckets).select(F.col("batch").alias("snapshot"), "bucket", "key")
    return keyed.groupBy("snapshot", "bucket").applyInPandas(
        build, "snapshot int, bucket int, seed int, segment int, segments int, prints binary"
    )


def screened(classes: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """(digest, batch, snapshot) of the digests that a filter of an earlier batch lets through."""

    def probe(incoming: pd.DataFrame, made: pd.DataFrame) -> pd.DataFrame:
        if made.empty or incoming.empty:
            return incoming.iloc[:0][["digest", "batch", "snapshot"]]
        row = made.iloc[0]
        fuse = BinaryFuse(int(row.seed), int(row.segment), int(row.segments), np.frombuffer(row.prints, np.uint16))
        return incoming[fuse.contains(incoming["key"].to_numpy().view(np.uint64))][["digest", "batch", "snapshot"]]

    later = _keyed(classes.where("batch > 0"), buckets).select(
        "digest", "batch", "bucket", "key", F.explode(F.sequence(F.lit(0), F.col("batch") - 1)).alias("snapshot")
    )
    return (
        later.groupBy("snapshot", "bucket")
        .cogroup(filters.groupBy("snapshot", "bucket"))
        .applyInPandas(probe, "digest binary, batch int, snapshot int")
    )


def _same_bytes(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (digest, batch, snapshot, new_id, old_id) whose texts are the same bytes without white space."""
    sides = [
        pairs.select("digest", "batch", "snapshot", F.col(f"{side}_id").alias("want"), F.lit(side == "new").alias("new"))
        for side in ("new", "old")
    ]
    wanted = sides[0].unionByName(sides[1])
    found = (
        texts.join(wanted.hint("merge"), texts["doc_id"].eqNullSafe(wanted["want"]))
        .where(F.unhex(F.sha2("plain", 256)) == F.col("digest"))  # of rows that share an id, the one that is meant
        .groupBy("digest", "batch", "snapshot", "new")
        .agg(F.min("plain").alias("plain"))
    )
    both = found.groupBy("digest", "batch", "snapshot").agg(
        F.count("*").alias("n"), F.min("plain").alias("a"), F.max("plain").alias("b")
    )
    return both.where("n = 2 AND a = b").select("digest", "batch", "snapshot")


def exact_dedup(docs: DataFrame, batch: Column, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, batch for each row of ``docs``.

    ``batch``: when a row arrives, 0 first; every batch before a row's own is a snapshot for it.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), batch.cast("int").alias("batch"))
    plain = F.translate("text", SPACE, "")
    rows = hand_off(
        slim.select("doc_id", "batch", F.unhex(F.sha2(plain, 256)).alias("digest"), F.length("text").alias("size")),
        "digests",
    )
    best = F.min(F.struct((-F.col("size")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("best")
    classes = hand_off(few_files(rows.groupBy("batch", "digest").agg(best, F.count("*").alias("n"))), "digest-classes")
    buckets = max(1, ceil(classes.count() / bucket))
    filters = hand_off(few_files(snapshot_filters(classes, buckets)), "fuse-filters")
    positive = screened(classes, filters, buckets)
    old = classes.select("digest", F.col("batch").alias("snapshot"), F.col("best.doc_id").alias("old_id"))
    new = classes.select("digest", "batch", F.col("best.doc_id").alias("new_id"))
    pairs = hand_off(few_files(positive.join(old, ["digest", "snapshot"]).join(new, ["digest", "batch"])), "digest-positives")
    texts = id_and_text(docs, id_col, text_col).select("doc_id", plain.alias("plain"))
    same = hand_off(few_files(_same_bytes(pairs, texts)), "digest-links")
    linked = same.select("digest", "batch").unionByName(same.select("digest", F.col("snapshot").alias("batch"))).distinct()
    merged = (
        classes.join(linked, ["digest", "batch"], "left_semi")
        .groupBy("digest")
        .agg(F.min("best").alias("m_best"), F.sum("n").alias("m_n"))
        .join(linked, "digest")
    )
    final = classes.join(merged, ["digest", "batch"], "left").select(
        "digest", "batch", F.coalesce("m_best", "best")["doc_id"].alias("keep_id"), F.coalesce("m_n", "n").alias("group_size")
    )
    return rows.join(final, ["digest", "batch"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "batch",
    )
