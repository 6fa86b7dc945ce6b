"""Helpers the operators share: Arrow batches of bounded size, words of a batch, and tables of what a word becomes."""

from __future__ import annotations

import ctypes
import os
import weakref
import zlib
from collections.abc import Callable, Iterator
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: text bytes that one step inside a task works on; a longer single text is one step
STEP_BYTES = 4 << 20
#: white space of the contracts: \x20 and \x09 to \x0D
SPACE = " \t\n\x0b\x0c\r"


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is used from a checkout instead of being installed."""
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    importable(df.sparkSession)

    def run(batches):
        yield from fn(batches)
        hand_back()

    return df.mapInArrow(run, schema)


def hand_back() -> None:
    """Gives freed memory back to the system: a worker stays for later tasks, next to an executor that needs it."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that most operators read, whatever else the table has; null texts count as empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of ``column`` each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def strings(array: pa.Array) -> pa.StringArray:
    """``array`` as a plain string array without offset and nulls."""
    array = pc.fill_null(array.cast(pa.string()), "")
    return pa.concat_arrays([array])


def distinct_words(words: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Of each word its number among the distinct ones; the distinct ones."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


class Runs:
    """What words become: a run of integers for each word, kept for the life of a Python worker.

    ``make`` gets the list of words not seen before and returns a list of integer sequences, or an array of all of them
    one after another and one of their sizes. Past ``most`` words the table starts anew, so memory stays bounded whatever
    the vocabulary; results don't depend on it.
    """

    _all: "weakref.WeakSet[Runs]" = weakref.WeakSet()

    def __init__(self, make: Callable[[list[str]], list], dtype=np.uint32, most: int = 600_000):
        self.make, self.dtype, self.most = make, dtype, most
        self._reset()
        Runs._all.add(self)

    def alone(self) -> None:
        """Empties the tables of other operators: a worker outlives the stage that filled them."""
        others = [t for t in Runs._all if t is not self and t.rows]
        for other in others:
            other._reset()
        if others:
            hand_back()

    @classmethod
    def empty_all(cls) -> None:
        """Empties all tables, for a stage that needs none of them."""
        for table in cls._all:
            if table.rows:
                table._reset()
        hand_back()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 16, self.dtype), 0
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _add(self, words: list[str]) -> None:
        runs = self.make(words)
        if isinstance(runs, tuple):
            runs, sizes = [runs[0]], runs[1]
        else:
            sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        more, old = int(sizes.sum()), len(self.rows)
        if self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(self.used, more) + more, self.dtype)])
        if old + len(words) > len(self.size):
            grown = max(old, len(words)) + len(words)
            self.first = np.concatenate([self.first[:old], np.zeros(grown, np.int64)])
            self.size = np.concatenate([self.size[:old], np.zeros(grown, np.int32)])
        if more:
            if isinstance(runs[0], np.ndarray):
                self.flat[self.used : self.used + more] = np.concatenate(runs)
            else:
                self.flat[self.used : self.used + more] = np.fromiter(chain.from_iterable(runs), self.dtype, more)
        self.first[old : old + len(words)] = self.used + np.cumsum(sizes) - sizes
        self.size[old : old + len(words)] = sizes
        self.used += more
        self.rows.update(zip(words, range(old, old + len(words))))

    def rows_of(self, words: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        missing = [words[i] for i in np.flatnonzero(found < 0)]
        if missing:
            if len(self.rows) + len(missing) > self.most:
                self._reset()
                missing = list(words)
                found[:] = -1
            old = len(self.rows)
            self._add(missing)
            found[found < 0] = np.arange(old, old + len(missing))
        return found

    def expand(self, which: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The runs of ``words[which]`` one after another, and where each ends."""
        rows = self.rows_of(words)[which]
        sizes = self.size[rows]
        ends = np.cumsum(sizes, dtype=np.int64)
        if not len(ends):
            return np.empty(0, self.dtype), ends
        at = np.repeat(self.first[rows] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.flat[at], ends


def crc32(values: np.ndarray) -> int:
    """Unsigned crc32 of the values as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(values, dtype="<u4"))


def shared_root(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's shared folder."""
    import uuid

    from tillwatch.session import shared_folder

    return f"{shared_folder(spark)}/tillwatch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def words_of(texts: pa.StringArray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words (runs without white space) of all texts: their numbers in the dictionary, it, and where each text begins.

    The last array has one entry more than texts.
    """
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # space at an end gives an empty word
    cut = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    if not full.all():
        cut = np.concatenate([[0], np.cumsum(full)])[cut]
        flat = flat.filter(pa.array(full))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, cut.astype(np.int64)


def sums(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring cuts; exact for integers and booleans."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[cut])
