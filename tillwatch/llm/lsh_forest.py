"""Near-duplicate documents by an LSH forest: sorted signature orders, neighbours by common prefix, exact confirmation.

Texts are lower-cased (A-Z) and cut into words; a document's set is its distinct word shingles of ``words`` words, or
its whole sequence when it is shorter. Documents with equal sets are one class from then on. Two classes are linked if
``100 * intersection >= percent * union`` of their whole sets; components of links are the groups.

A MinHash signature has ``TREES * DEPTH`` values. Each tree of the forest is one order of the signature: its own
``DEPTH`` values first, then the values after them. Classes sorted by that order form regions of a common prefix of
``DEPTH``; two classes at 80 % meet in a region of some tree but for one case in twenty million, at 85 % one in ten
billion.

1. In every region, sorted neighbours are candidates: those with the longest common prefix. How deep a prefix goes
   depends on the region: where thousands of classes share it, the neighbours share far more of the order.
2. Candidates are confirmed on whole sets, and links contracted to components.
3. Regions that still hold several components are read again, in squares of bounded size: every class outside a
   region's largest component is compared with all of the region, on whole sets. So no region is cut short, and
   nothing is paired inside a component.
4. Links found there are contracted with the others.

Forests exchange fixed-size rows, never texts, and whole sets move only for classes that share a region. No group is expanded into all
its pairs: copies are one class, and classes already joined by links are never paired again.

Defined results: null texts are empty; documents without words have no shingles, are linked with nothing and stay; a
null ``doc_id`` counts after all others, and a group of null ids alone has a null component; repeated rows are in one
class, all kept or none, as ``kept`` is ``doc_id = component_id``; empty tables give no rows; other columns are ignored;
a text of any length is read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.fuse_dedup import mixed
from tillwatch.llm.texts import Runs, distinct_words, id_and_text, map_batches, steps, strings
from tillwatch.session import few_files, hand_off

TREES, DEPTH, DEEPER = 32, 4, 8
VALUES = TREES * DEPTH
WORDS = 5
#: words whose hashes a worker keeps, some 200 bytes each
KNOWN = 300_000
#: classes in a block of a large region
BLOCK = 4096
_RNG = np.random.default_rng(20)
FACTORS = _RNG.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _RNG.integers(0, 2**64, VALUES, dtype=np.uint64)


class Shingler:
    """Sets of shingle hashes; one per Python worker, as it keeps the hashes of words."""

    _one: "Shingler | None" = None

    def __init__(self):
        # two independent halves of a word's digest, so that a shingle's hash has 64 good bits
        self.words = Runs(lambda ws: [np.frombuffer(hashlib.blake2b(w.encode(), digest_size=8).digest(), np.uint64) for w in ws], np.uint64, KNOWN)

    @classmethod
    def one(cls) -> "Shingler":
        cls._one = cls._one or cls()
        return cls._one

    def sets(self, texts: pa.Array, words: int) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text; 64 bits each."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(strings(texts)))
        flat = lists.flatten()
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        cut = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        hashes, _ = self.words.expand(*distinct_words(flat.filter(pa.array(full))))
        n = np.diff(cut)
        with np.errstate(over="ignore"):
            rolled = np.zeros(len(hashes), np.uint64)
            for k in range(words):
                part = np.zeros(len(hashes), np.uint64)
                part[: len(hashes) - k] = hashes[k:] if k else hashes
                rolled = mixed(rolled ^ part, 2 * k + 1)
        out = []
        for a, size in zip(cut.tolist(), n.tolist()):
            if size >= words:
                out.append(np.unique(rolled[a : a + size - words + 1]))
            elif size:
                whole = np.array([size], np.uint64)
                for h in hashes[a : a + size]:
                    whole = mixed(whole ^ h, 100)
                out.append(whole)
            else:
                out.append(np.empty(0, np.uint64))
        return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest of each hash function over the set, 32 bits each."""
    out = np.full(VALUES, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for a in range(0, len(shingles), 2048):
            part = shingles[a : a + 2048]
            np.minimum(out, (part[:, None] * FACTORS + TERMS).min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, cls (128-bit digest of the set, null without shingles) and sig of each row."""

    def run(batches):
        shingler = Shingler.one()
        for batch in steps(batches):
            sets = shingler.sets(batch.column("text"), words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "cls", "sig"],
            )

    return map_batches(docs, run, "doc_id long, n_shingles long, cls binary, sig binary")


def forest(classes: DataFrame) -> DataFrame:
    """Of each class and tree: key (tree and prefix of ``DEPTH``), path (the next values of the order), cls."""

    def run(batches):
        order = (np.arange(TREES)[:, None] * DEPTH + np.arange(DEPTH + DEEPER)) % VALUES
        for whole in batches:
            for a in range(0, whole.num_rows, 2048):
                batch = whole.slice(a, 2048)
                n = batch.num_rows
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, VALUES)
                key = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), (n, TREES)).ravel().copy()
                values = sig[:, order].reshape(n * TREES, DEPTH + DEEPER)
                for k in range(DEPTH):
                    key = mixed(key ^ values[:, k].astype(np.uint64), 7 + k)
                path = np.ascontiguousarray(values[:, DEPTH:].astype(">u2"))
                paths = pa.Array.from_buffers(pa.binary(2 * DEEPER), n * TREES, [None, pa.py_buffer(path)]).cast(pa.binary())
                cls = batch.column("cls").take(pa.array(np.repeat(np.arange(n), TREES)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), paths, cls], ["key", "path", "cls"])

    return map_batches(classes.select("cls", "sig"), run, "key long, path binary, cls binary")


def regions(entries: DataFrame) -> DataFrame:
    """Classes that share a key with another one: key, cls, next (the sorted neighbour behind it), depth of their prefix."""

    def run(batches):
        key, path, cls, joined = np.empty(0, np.int64), [], [], False

        def rows(keys, paths, classes, joined, last):
            """Rows in a region; without ``last`` the final row waits for its neighbour."""
            if not len(keys):
                return None
            same = keys[1:] == keys[:-1]
            nxt, prev = np.concatenate([same, [False]]), np.concatenate([[joined], same])
            take = np.flatnonzero((nxt | prev)[: len(keys) if last else -1])
            if not len(take):
                return None
            depth = np.zeros(len(keys), np.int32)
            at = np.flatnonzero(same)
            values = np.frombuffer(b"".join(paths), ">u2").reshape(-1, DEEPER)
            depth[at] = DEPTH + np.cumprod(values[at] == values[at + 1], axis=1).sum(1)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[take]),
                    pa.array([classes[i] for i in take], pa.binary()),
                    pa.array([classes[i + 1] if nxt[i] else None for i in take], pa.binary()),
                    pa.array(depth[take]),
                ],
                ["key", "cls", "next", "depth"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([key, batch.column("key").to_numpy()])
            path += batch.column("path").to_pylist()
            cls += batch.column("cls").to_pylist()
            if (got := rows(key, path, cls, joined, False)) is not None:
                yield got
            joined = bool(len(key) > 1 and key[-1] == key[-2]) or (len(key) == 1 and joined)
            key, path, cls = key[-1:], path[-1:], cls[-1:]
        if (got := rows(key, path, cls, joined, True)) is not None:
            yield got

    dealt = entries.repartition("key").sortWithinPartitions("key", "path", "cls")
    return map_batches(dealt, run, "key long, cls binary, next binary, depth int")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cls and set (sorted 64-bit hashes) of the wanted classes (cls, rep: id of a document with that set)."""

    def run(batches):
        shingler = Shingler.one()
        for batch in steps(batches):
            sets = shingler.sets(batch.column("text"), words)
            want = batch.column("cls").to_pylist()
            hit = [i for i, s in enumerate(sets) if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == want[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([want[i] for i in hit], pa.binary()), pa.array([sets[i].tobytes() for i in hit], pa.binary())], ["cls", "set"]
            )

    found = docs.join(wanted.hint("merge"), docs["doc_id"].eqNullSafe(wanted["rep"])).select("text", "cls")
    return map_batches(found, run, "cls binary, set binary").dropDuplicates(["cls"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""

    def run(batches):
        for batch in batches:
            hit = []
            for i, (x, y) in enumerate(zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    hit.append(i)
            at = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    sided = pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a")), "a")
    sided = sided.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b")), "b")
    return map_batches(sided.select("a", "b", "set_a", "set_b"), run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node and root (its least node) of all nodes that the links (a, b) join, by alternating stars.

    Every round a node hands the neighbours above it, then those below it, to the least it knows. Rounds grow with the
    logarithm of the longest chain; each is a table of its own.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Joins neighbours above (``large``) or not above a node with the least node it sees."""
        seen = both(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = seen.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        moved = seen.join(least, "a")
        if large:
            return moved.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        out = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(moved.select("a", F.col("low").alias("b")))
        return out.where("a <> b").distinct()

    def mark(edges: DataFrame):
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])

    edges = hand_off(few_files(links.where("a <> b").select("a", "b").distinct()), "links")
    before = None
    while (now := mark(edges)) != before:
        before = now
        edges = hand_off(few_files(star(star(edges, True), False)), "stars")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def open_regions(region: DataFrame, joined: DataFrame, block: int = BLOCK) -> DataFrame:
    """Where pairs across components are left: key, x, y, cls, root, in_x, in_y.

    A region of three classes or more in several components (with two, the neighbours have been confirmed or refuted)
    is dealt to squares ``(x, y)``: the classes outside its largest component, by blocks ``x``, meet all classes, by
    blocks ``y``. A block has about ``block`` classes, so a square's memory is bounded however large a region is.
    """
    parts = region.select("key", "cls").join(joined, F.col("cls") == F.col("node"), "left")
    parts = parts.select("key", "cls", F.coalesce("root", "cls").alias("root"))
    sizes = parts.groupBy("key", "root").count().groupBy("key")
    sizes = sizes.agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("m"), F.count("*").alias("k"))
    sizes = sizes.where("k > 1 AND m > 2").select("key", "main", F.expr(f"CAST(ceil(m / {block}) AS INT)").alias("blocks"))
    rows = parts.join(sizes, "key").withColumn("mine", F.pmod(F.hash("cls"), F.col("blocks")))
    square = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    all_ = F.sequence(F.lit(0), F.col("blocks") - 1)
    down = F.transform(all_, lambda x: square(x, F.col("mine")))
    across = F.transform(all_, lambda y: square(F.col("mine"), y))
    rest = F.col("root") != F.col("main")
    at = F.explode(F.when(rest, F.array_union(down, across)).otherwise(down)).alias("at")
    return rows.select("key", "cls", "root", "mine", rest.alias("rest"), at).select(
        "key", "at.x", "at.y", "cls", "root", (F.col("rest") & (F.col("mine") == F.col("at.x"))).alias("in_x"), (F.col("mine") == F.col("at.y")).alias("in_y")
    )


def crossing_links(squares: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components of open regions, confirmed on whole sets; enough of them to join what belongs together."""

    def links(held):
        cls, root, in_x, in_y, raw = zip(*held)
        _, label = np.unique(np.array(root, object), return_inverse=True)
        label, y = label.copy(), np.flatnonzero(in_y)
        sets_ = [np.frombuffer(r, np.uint64) for r in raw]
        size = np.array([len(s) for s in sets_], np.int64)
        _, codes = np.unique(np.concatenate(sets_), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(size)])
        flat = np.concatenate([codes[begin[j] : begin[j + 1]] for j in y]) if len(y) else codes[:0]
        starts, mine = np.cumsum(size[y]) - size[y], np.zeros(int(codes.max()) + 1, np.int32)
        for i in np.flatnonzero(in_x) if len(y) else ():
            own = codes[begin[i] : begin[i + 1]]
            mine[own] = 1
            both = np.add.reduceat(mine[flat], starts)
            mine[own] = 0
            for j in y[100 * both >= percent * (size[i] + size[y] - both)]:
                if label[i] != label[j]:  # what this square has joined needs no second link
                    label[label == label[j]] = label[i]
                    yield min(cls[i], cls[j]), max(cls[i], cls[j])

    def run(batches):
        held, at, found = [], None, []
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "x", "y", "cls", "root", "in_x", "in_y", "set")))
            for key, x, y, *row in rows:
                if (key, x, y) != at:
                    found += links(held) if len(held) > 1 else ()
                    at, held = (key, x, y), []
                held.append(row)
            if found:
                a, b = zip(*found)
                found = []
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        found = list(links(held)) if len(held) > 1 else []
        if found:
            a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    dealt = squares.join(sets, "cls").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return map_batches(dealt, run, "a binary, b binary").distinct()


def near_groups(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept and set_digest (equal for equal sets) for each row of ``docs``."""
    slim = id_and_text(docs, id_col, text_col)
    table = hand_off(few_files(signatures(slim, words)), "signatures")
    ids = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    classes = table.where("cls IS NOT NULL").groupBy("cls").agg(ids, F.min("n_shingles").alias("n"), F.min("sig").alias("sig"))
    classes = hand_off(few_files(classes.select("cls", F.col("first.doc_id").alias("rep"), "n", "sig")), "set-classes")
    region = hand_off(few_files(regions(forest(classes))), "regions")
    near = region.where("next IS NOT NULL").select(F.least("cls", "next").alias("a"), F.greatest("cls", "next").alias("b"))
    near = hand_off(few_files(near.distinct()), "neighbours")
    wanted = region.select("cls").distinct().join(classes.select("cls", "rep"), "cls")
    sets = hand_off(few_files(shingle_sets(slim, wanted, words)), "sets")
    links = hand_off(few_files(confirmed(near, sets, percent)), "neighbour-links")
    joined = components(links)
    squares = open_regions(region, joined)
    more = hand_off(few_files(crossing_links(squares, sets, percent)), "crossing-links")
    final = components(joined.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = final.join(classes, F.col("node") == F.col("cls")).groupBy("root")
    named = named.agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep")).alias("low"))
    of_class = (
        classes.select("cls", "rep")
        .join(final.withColumnRenamed("node", "cls"), "cls", "left")
        .join(named, "root", "left")
        .select("cls", F.when(F.col("low").isNull(), F.col("rep")).otherwise(F.col("low.rep")).alias("of"))
    )
    out = table.select("doc_id", "n_shingles", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("of"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        F.lower(F.hex("cls")).alias("set_digest"),
    )
