"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Words and pairs of neighbouring words are hashed to buckets. Two multinomials over the buckets are counted over whole
tables: the target over documents that labels trust, the raw one over all documents. The score of a document is the
sum of log(p_target / p_raw) over its n-grams, divided by their number. Of the trusted documents that pass the base
rules, take the median score and the one that all but ``spare`` of them reach: the threshold lies ``slack`` times as far
below the median as the latter, so that good documents of a kind the labels hardly show stay. Every document at or
above it is kept.

Scores are sums of ratios in units of 1e-6, so they are the same however rows are dealt out, and the threshold is
deterministic.

Defined results: a null text has no words; without words all counts are 0, the score is 0 and the base rules fail; rows
of a repeated or null ``doc_id`` are judged one by one; a document with contradicting labels isn't trusted; without
trusted documents nothing but the base rules decides; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.texts import id_and_text, map_batches, steps, strings, sums, words_of
from tillwatch.session import hand_off

BUCKETS = 1 << 16
#: share of trusted documents below the low mark; how much farther than it the threshold is from the median
SPARE, SLACK = 0.005, 2.5
UNIT = 1_000_000
SYMBOLS = "[#*$%&|<>]"


def ngram_buckets(codes: np.ndarray, words: pa.Array, cut: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, then of all pairs inside a text; the text of each."""
    hashes = np.array([zlib.crc32(w) for w in pc.cast(words, pa.binary()).to_pylist()], np.uint64)[codes] if len(codes) else np.empty(0, np.uint64)
    text = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    inside = np.flatnonzero(text[1:] == text[:-1])
    pair = (hashes[inside] * np.uint64(0x9E3779B1) + hashes[inside + 1] * np.uint64(0x85EBCA77)) >> np.uint64(13)
    single = hashes * np.uint64(0xC2B2AE3D) >> np.uint64(13)
    both = np.concatenate([single, pair]) % np.uint64(buckets)
    return both.astype(np.int64), np.concatenate([text, text[inside]])


def repeated_words(codes: np.ndarray, n_words: int, cut: np.ndarray) -> np.ndarray:
    """Of each text the words that lie in a window of three words found at least twice in it."""
    text = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    at = np.flatnonzero(text[2:] == text[:-2]) if len(text) > 2 else np.empty(0, np.int64)
    _, pair = np.unique(codes[at] * n_words + codes[at + 1], return_inverse=True)
    _, window = np.unique(pair * n_words + codes[at + 2], return_inverse=True)
    _, which, count = np.unique(window * len(cut) + text[at], return_inverse=True, return_counts=True)
    again, hit = at[count[which] > 1], np.zeros(len(codes), bool)
    for k in range(3):
        hit[again + k] = True
    return sums(hit, cut)


def repeated_lines(texts: pa.StringArray) -> np.ndarray:
    """Of each text the lines with a word that equal an earlier line of it."""
    lists = pc.split_pattern(texts, "\n")
    coded = lists.flatten().dictionary_encode()
    wordy = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)
    code, text = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    mine = wordy[code]
    keys, count = np.unique(text[mine] * max(1, len(wordy)) + code[mine], return_counts=True)
    return np.bincount(keys // max(1, len(wordy)), count - 1, len(texts)).astype(np.int64)


def base_counts(texts: pa.StringArray, codes: np.ndarray, words: pa.Array, cut: np.ndarray) -> dict[str, np.ndarray]:
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    symbols = pc.count_substring_regex(words, SYMBOLS).to_numpy(zero_copy_only=False)
    return {
        "n_words": np.diff(cut),
        "word_chars": sums(size[codes], cut),
        "n_symbols": sums(symbols[codes], cut),
        "n_dup_lines": repeated_lines(texts),
        "n_repeat_words": repeated_words(codes, max(1, len(words)), cut),
    }


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Documents that all of their labels call good."""
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id"))
    return known.agg(F.min(F.coalesce(F.col(label_col), F.lit(0))).alias("low")).where("low = 1").select("doc_id")


def bucket_counts(texts: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams in each bucket over trusted rows and over all rows; ``buckets`` rows reach the driver at most."""

    def count(batches):
        totals = np.zeros((2, buckets), np.int64)
        for batch in steps(batches):
            got, text = ngram_buckets(*words_of(strings(batch.column("text"))), buckets)
            totals[1] += np.bincount(got, minlength=buckets)
            mine = batch.column("trusted").to_numpy(zero_copy_only=False).astype(bool)
            totals[0] += np.bincount(got[mine[text]], minlength=buckets)
        seen = np.flatnonzero(totals[1])
        yield pa.RecordBatch.from_pydict({"bucket": seen, "target": totals[0][seen], "raw": totals[1][seen]})

    counted = map_batches(texts, count, "bucket long, target long, raw long").groupBy("bucket")
    target, raw = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for b, t, r in counted.agg(F.sum("target"), F.sum("raw")).collect():
        target[b], raw[b] = t, r
    return target, raw


def ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(p_target / p_raw) of each bucket with one added to each count, in units of 1e-6; 0 without a target."""
    if not target.sum():
        return np.zeros(len(raw), np.int64)
    p, q = np.log(target + 1.0) - np.log(target.sum() + len(raw)), np.log(raw + 1.0) - np.log(raw.sum() + len(raw))
    return np.rint((p - q) * UNIT).astype(np.int64)


def scored(docs: DataFrame, ratio: np.ndarray, min_words: int, max_repeat: int) -> DataFrame:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches):
        for batch in steps(batches):
            texts = strings(batch.column("text"))
            codes, words, cut = words_of(texts)
            got = base_counts(texts, codes, words, cut)
            grams, text = ngram_buckets(codes, words, cut, len(ratio))
            # halves of a 52-bit sum stay exact in doubles
            total = np.bincount(text, ratio[grams], len(texts)) if len(grams) else np.zeros(len(texts))
            n = np.maximum(np.bincount(text, minlength=len(texts)), 1)
            n_words = got["n_words"]
            failed = (n_words < min_words) | (100 * got["n_repeat_words"] > max_repeat * n_words)
            columns = [batch.column("doc_id"), *(pa.array(got[c].astype(np.int64)) for c in names), pa.array(failed), pa.array(total / n / UNIT)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "llr"])

    kinds = ", ".join(f"{c} long" for c in names)
    return map_batches(docs, score, f"doc_id long, {kinds}, base_failed boolean, llr double")


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    min_words: int = 50,
    max_repeat: int = 50,
    spare: float = SPARE,
    slack: float = SLACK,
    buckets: int = BUCKETS,
) -> DataFrame:
    """doc_id, the counts, base_failed, llr (score), threshold and kept for each row of ``docs``."""
    trusted = trusted_ids(labels).withColumn("trusted", F.lit(True))
    slim = id_and_text(docs)
    # labels grow with the documents, so they are never broadcast
    marked = slim.join(trusted.hint("merge"), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    ratio = ratios(*bucket_counts(marked, buckets))
    table = hand_off(scored(slim, ratio, min_words, max_repeat), "ngram-scores")
    # scores by thousandths: a few ten thousand values, as ratios are bounded by the logarithms of the counts
    steps_of = table.where("NOT base_failed").join(trusted, "doc_id", "left_semi").groupBy(F.floor(F.col("llr") * 1000).alias("step"))
    counted = sorted((s, n) for s, n in steps_of.count().collect())
    ranks = np.cumsum([n for _, n in counted])
    at = lambda share: counted[int(np.searchsorted(ranks, share * ranks[-1], side="right"))][0] / 1000
    threshold = at(0.5) - slack * (at(0.5) - at(spare)) if counted else -1e9
    kept = ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold))
    return table.withColumns({"threshold": F.lit(threshold), "kept": kept})
