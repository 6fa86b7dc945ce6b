"""Token ids as wavelet matrices: succinct shard files that give, count and find tokens without being unpacked.

A shard file holds the ids of consecutive documents. It is a chain of segments of bounded size, each a wavelet matrix:
one bit plane for each bit of an id, the most significant first, and with every plane the ids stably dealt to zeros and
ones. A plane carries the number of ones before each block of 512 bits, so that

* ``access(i)`` follows one position down the planes,
* ``rank(t, i)`` counts token ``t`` before ``i`` by following an interval,
* ``select(t, k)`` finds its k-th occurrence by climbing back.

``write_shards`` writes such files in ascending ``doc_id`` order, ``read_documents`` reads documents back from them.

Nulls, ties: a null text is empty and gives the end id only; a null ``doc_id`` sorts first; repeated rows are documents
of their own, in the order of their texts. Empty tables give no file and no rows. Other columns are ignored. Memory in
a task is bounded by a segment, not by a shard, so very long texts and very common ids only make longer files.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwatch.llm.byte_bpe import ByteBpe
from tillwatch.llm.texts import crc32, id_and_text, map_batches, shared_root, steps
from tillwatch.session import hand_off

MAGIC = b"TWWM0001"
BLOCK = 512
#: tokens of a segment, unless a single text has more
SEGMENT = 2_000_000
#: documents of a shard file
SHARD_DOCS = 8192
HEAD = struct.Struct("<8sIIQQ")  # magic, planes, documents, tokens, bytes that follow


class WaveletMatrix:
    """Planes of packed bits with block counts; positions and counts are 0-based."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.blocks = [self._blocks(p) for p in planes]

    @staticmethod
    def _blocks(plane: np.ndarray) -> np.ndarray:
        step = BLOCK // 8
        counts = np.bitwise_count(np.pad(plane, (0, -len(plane) % step))).reshape(-1, step).sum(1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(counts)])

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> "WaveletMatrix":
        a = np.ascontiguousarray(ids, dtype=np.uint16 if width <= 16 else np.uint32)
        planes, zeros = [], []
        for bit in range(width - 1, -1, -1):
            ones = (a & a.dtype.type(1 << bit)) != 0
            planes.append(np.packbits(ones, bitorder="little"))
            # compress is a few times faster than an index of flags
            low = a.compress(~ones)
            zeros.append(len(low))
            a = np.concatenate([low, a.compress(ones)])
        return cls(len(a), planes, zeros)

    def ids(self) -> np.ndarray:
        """All ids in order, by dealing the planes back from the last to the first."""
        width = len(self.planes)
        a = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        for level in range(width - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            back = np.empty_like(a)
            back[np.flatnonzero(~ones)] = a[: self.zeros[level]]
            back[np.flatnonzero(ones)] = a[self.zeros[level] :] | a.dtype.type(1 << (width - 1 - level))
            a = back
        return a

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position ``i``."""
        plane, b = self.planes[level], i // BLOCK
        whole = plane[b * BLOCK // 8 : i // 8]
        count = int(self.blocks[level][b]) + int(np.bitwise_count(whole).sum())
        return count + (int(plane[i // 8] & ((1 << i % 8) - 1)).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            one = int(self.planes[level][i // 8]) >> (i % 8) & 1
            before = self._ones(level, i)
            i = self.zeros[level] + before if one else i - before
            value = value << 1 | one
        return value

    def _interval(self, token: int, i: int) -> tuple[int, int]:
        """Where occurrences of ``token`` before ``i`` lie below the last plane."""
        a, b, width = 0, i, len(self.planes)
        for level in range(width):
            x, y = self._ones(level, a), self._ones(level, b)
            one = token >> (width - 1 - level) & 1
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if one else (a - x, b - y)
        return a, b

    def rank(self, token: int, i: int) -> int:
        if token >> len(self.planes):
            return 0
        a, b = self._interval(token, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of occurrence ``k`` of ``token``, -1 if it has fewer."""
        if token >> len(self.planes) or k < 0:
            return -1
        a, b = self._interval(token, self.n)
        if k >= b - a:
            return -1
        at, width = a + k, len(self.planes)
        for level in range(width - 1, -1, -1):
            one = token >> (width - 1 - level) & 1
            at = self._find(level, one, at - self.zeros[level] if one else at)
        return at

    def _find(self, level: int, one: int, k: int) -> int:
        """Position of the k-th zero or one of a plane: by blocks, then inside one."""
        blocks = self.blocks[level]
        before = blocks if one else np.arange(len(blocks)) * BLOCK - blocks
        b = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][b * BLOCK // 8 : (b + 1) * BLOCK // 8], bitorder="little")
        return b * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[b])])

    def to_bytes(self) -> bytes:
        return struct.pack(f"<{len(self.zeros)}Q", *self.zeros) + b"".join(p.tobytes() for p in self.planes)

    @classmethod
    def from_bytes(cls, data: memoryview, n: int, width: int) -> "WaveletMatrix":
        zeros, at, step = list(struct.unpack_from(f"<{width}Q", data)), 8 * width, (n + 7) // 8
        return cls(n, [np.frombuffer(data, np.uint8, step, at + k * step) for k in range(width)], zeros)


def write_segment(out, doc_ids: list, ids: np.ndarray, ends: np.ndarray, width: int) -> None:
    """One segment: header, document table (known ids, ids, ends), planes; tables and planes compressed."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    table = known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + ends.astype("<i8").tobytes()
    table = zstandard.compress(table, 1)
    body = struct.pack("<Q", len(table)) + table + zstandard.compress(WaveletMatrix.build(ids, width).to_bytes(), 1)
    out.write(HEAD.pack(MAGIC, width, len(doc_ids), len(ids), len(body)) + body)


def read_segments(stream) -> Iterator[tuple[list, np.ndarray, WaveletMatrix]]:
    """Of each segment of a file the document ids, where their tokens end, and the matrix."""
    while head := stream.read(HEAD.size):
        magic, width, docs, n, size = HEAD.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        body = memoryview(stream.read(size))
        cut = 8 + struct.unpack_from("<Q", body)[0]
        table = zstandard.decompress(body[8:cut])
        known = np.frombuffer(table, np.uint8, docs)
        doc_ids = np.frombuffer(table, "<i8", docs, docs)
        ends = np.frombuffer(table, "<i8", docs, 9 * docs)
        matrix = WaveletMatrix.from_bytes(memoryview(zstandard.decompress(body[cut:])), n, width)
        yield [d if k else None for d, k in zip(doc_ids.tolist(), known)], ends, matrix


def _storage(uri: str):
    """File system and path of a folder in any store that pyarrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int, width: int = 16, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Writes one file for each range of ``doc_id`` and returns the committed files: (shard, file, docs, tokens).

    Ranges come from one sort by range, so files follow each other in ascending ``doc_id``. A task writes to a name of
    its own and reports it when the file is closed; a task that runs again after a lost executor writes another file,
    and only reported files are in the table of files, which is stored itself.
    """
    slim = id_and_text(docs)
    count = slim.select("doc_id").count()
    parts = slim.repartitionByRange(max(1, ceil(count / shard_docs)), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        encoder, shard = ByteBpe.of(path), TaskContext.get().partitionId()
        store, base = _storage(folder)
        store.create_dir(base, recursive=True)
        name, out, docs_n, total = f"{base}/shard-{shard:07d}-{uuid.uuid4().hex}.wm", None, 0, 0
        held, ids, ends, n = [], [], [], 0
        for batch in steps(batches):
            got, cut = encoder.encode(batch.column("text"))
            # the end id goes behind each document's ids
            cut = np.asarray(cut, np.int64)
            with_end = np.insert(got, cut, end_id)
            held += batch.column("doc_id").to_pylist()
            ids.append(with_end)
            ends.append(n + cut + np.arange(1, len(cut) + 1))
            n += len(with_end)
            if n >= SEGMENT:
                out = out or store.open_output_stream(name)
                write_segment(out, held, np.concatenate(ids), np.concatenate(ends), width)
                docs_n, total, held, ids, ends, n = docs_n + len(held), total + n, [], [], [], 0
        if held:
            out = out or store.open_output_stream(name)
            write_segment(out, held, np.concatenate(ids), np.concatenate(ends), width)
            docs_n, total = docs_n + len(held), total + n
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name.rpartition("/")[2]], "docs": [docs_n], "tokens": [total]})

    return hand_off(map_batches(parts, write, "shard long, file string, docs long, tokens long"), "token-shards")


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """Documents of the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    # tokens of the shards before each: sums of 1,024 shards first, so that no task sees all shards of a large corpus
    group = F.expr("shard div 1024")
    groups = files.groupBy(group.alias("part")).agg(F.sum("tokens").alias("all_tokens"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("part", F.coalesce(F.sum("all_tokens").over(upto), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        files.withColumn("part", group)
        .withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
        .join(groups, "part")
        .select("file", (F.col("part_start") + F.col("inside")).alias("at"))
    )

    def read(batches):
        store, base = _storage(folder)
        for batch in batches:
            for name, at in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist()):
                with store.open_input_stream(f"{base}/{name}") as stream:
                    for doc_ids, ends, matrix in read_segments(stream):
                        ids, begins = matrix.ids(), np.concatenate([[0], ends[:-1]])
                        wide = ids.astype("<u4")
                        yield pa.RecordBatch.from_pydict(
                            {
                                "doc_id": pa.array(doc_ids, pa.int64()),
                                "start": begins + at,
                                "n_tokens": ends - begins,
                                "ids_crc32": pa.array([crc32(wide[a:b]) for a, b in zip(begins, ends)], pa.int64()),
                            }
                        )
                        at += len(ids)

    # one file for a task: files are few and large
    spread = placed.repartition(max(1, files.count()), F.xxhash64("file"))
    return map_batches(spread, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encodes ``docs`` with the vocabulary file ``path``, writes shard files to the shared folder and reads them back."""
    folder = shared_root(spark, "tokens")
    return read_documents(write_shards(docs, path, folder, end_id, shard_docs=shard_docs), folder)
