"""Alignment of the tokens of two tokenizers by products of sparse matrices.

Both tokenizers cut the same bytes. Token-byte incidence matrices A and B have a row for each token and a column for each
byte, in hand-built CSR (row starts, columns, values). The rows of A times the transpose of B, by Gustavson's method (the
rows of the second factor that a row of the first one names are gathered and summed by column), are the overlap links: a
pair of tokens and the bytes that both have. Offsets where tokens of both end cut the tokens into groups; the product of the
two token-group incidence matrices holds the shared-group links. Documents are blocks on a diagonal: they share no byte,
so one product serves a slice of many.

Overlap links whose byte ranges end together are counted by pair of ids over the whole corpus:

1. ``link_blocks``: both tokenizers always cut where a space or line feed begins a unit, so the product is a block on the
   diagonal for each unit, and equal units are equal blocks: a worker makes each distinct one once. A task writes its links by
   slices of ``BLOCK_BYTES`` of text: the distinct pairs with their numbers, each distinct unit's links as
   numbers of pairs, and each document as numbers of units. A text with other white space is one unit. Texts never move.
2. Pairs are summed over blocks, and the highest count of a B id is taken.
3. Counts go back to the blocks that have the pair, and are gathered there as one array along the block's pairs.

What is shuffled is distinct pairs of blocks, and numbers of two bytes for most units. A pair that every document has is one
row a block. The only table that is broadcast has a row for each id of the B vocabulary, which is its bound.

Defined results: null and empty texts, and texts that either tokenizer gives back with other bytes, have no tokens (zeros and an
empty digest); a null ``doc_id`` stays null; repeated rows count each; ties for the highest count all count as best;
empty tables give no rows; other columns are ignored, whatever their names. A text of any length is one block at most, read
whole; products are made for ``PRODUCTS`` entries at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.byte_bpe import ODD, ByteBpe
from tillwatch.llm.suffix_pieces import MARK, Pieces
from tillwatch.llm.texts import distinct_words, id_and_text, map_batches, steps, strings
from tillwatch.session import HandOffs

#: text bytes of a block
BLOCK_BYTES = 4 << 20
#: entries of a product that are made at once
PRODUCTS = 1 << 20
#: distinct units whose links a worker keeps
KEPT = 150_000


class Csr(NamedTuple):
    """A sparse matrix by rows: where each row begins in ``columns`` and ``values``."""

    begins: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def height(self) -> int:
        return len(self.begins) - 1


def token_bytes(ends: np.ndarray, size: int) -> Csr:
    """Tokens by bytes: token ``i`` has the bytes from the end of the one before it to ``ends[i]``."""
    return Csr(np.concatenate([[0], ends]).astype(np.int64), np.arange(size), np.ones(size, np.int64), size)


def token_groups(group: np.ndarray, groups: int) -> Csr:
    """Tokens by groups: a one in each row."""
    return Csr(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), groups)


def transposed(m: Csr) -> Csr:
    rows = np.repeat(np.arange(m.height), np.diff(m.begins))
    if (np.diff(m.columns) >= 0).all():
        order = slice(None)
    else:
        order = np.argsort(m.columns, kind="stable")
    begins = np.concatenate([[0], np.cumsum(np.bincount(m.columns, minlength=m.width))])
    return Csr(begins, rows[order], m.values[order], m.height)


def row_products(a: Csr, b: Csr, most: int = PRODUCTS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and values of ``a`` times ``b``, for some rows of ``a`` at a time.

    About ``most`` entries are gathered at once, more only where a single row of ``a`` has more.
    """
    fan = b.begins[a.columns + 1] - b.begins[a.columns]
    through = np.concatenate([[0], np.cumsum(fan)])[a.begins]
    low = 0
    while low < a.height:
        high = max(low + 1, int(np.searchsorted(through, through[low] + most, "right")) - 1)
        cut = slice(int(a.begins[low]), int(a.begins[high]))
        named, many = a.columns[cut], fan[cut]
        rows = np.repeat(np.repeat(np.arange(low, high), np.diff(a.begins[low : high + 1])), many)
        ends = np.cumsum(many)
        at = np.arange(len(rows)) + np.repeat(b.begins[named] - ends + many, many)
        columns, values = b.columns[at], np.repeat(a.values[cut], many) * b.values[at]
        key = rows * np.int64(b.width) + columns
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, rows, columns, values = key[order], rows[order], columns[order], values[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        if len(first):
            yield rows[first], columns[first], np.add.reduceat(values, first)
        low = high


class SpacedBytes(ByteBpe):
    """Byte-level ids of a space and the text; strings of special tokens are text like any other."""

    _made: dict[str, "SpacedBytes"] = {}

    def __init__(self, path: str):
        super().__init__(path)
        self.library.encode_special_tokens = True
        raw = {c: bytes([b]) for b, c in enumerate(self.as_shown)}
        vocabulary = self.library.get_vocab()
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_of[i] = b"".join(raw[c] for c in token) if all(c in raw for c in token) else token.encode()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = strings(texts)
        odd = pc.match_substring_regex(texts, ODD)
        plain = pc.if_else(odd, "", texts)
        words = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        ids, ends = self.units.expand(*distinct_words(words.flatten()))
        ends = np.concatenate([[0], ends])[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]
        if odd.true_count:
            parts = np.split(ids, ends[:-1])
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                parts[i] = np.array(self.library.encode(" " + texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends


class Sides:
    """Both tokenizers, the bytes of their tokens and the decimals of their ids; one per Python worker."""

    _made: dict[tuple[str, str], "Sides"] = {}

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.coders = SpacedBytes.of(a), Pieces.of(b)
        self.sizes = [np.array([len(x) for x in c.bytes_of], np.int64) for c in self.coders]
        most = max(len(s) for s in self.sizes)
        #: an id and what follows it: another of its side, the other side, another group
        self.decimals = [f"{i}{mark}" for i in range(most) for mark in ",|;"]
        self.library = sentencepiece.SentencePieceProcessor(model_file=b)
        #: whether no piece of B crosses a line feed; A's tokens never do behind a letter
        self.cut_lines = not self.coders[1].joins_line
        self.units = Units(self)

    @classmethod
    def of(cls, a: str, b: str) -> "Sides":
        if (a, b) not in cls._made:
            cls._made[a, b] = cls(a, b)
        return cls._made[a, b]

    def cut(self, texts: pa.Array) -> "Cut":
        """The tokens of both sides of all texts."""
        texts = strings(texts)
        raw = [b" " + t.encode() if t else b"" for t in texts.to_pylist()]
        return self.cut_ids(raw, *(np.split(ids, ends[:-1]) for ids, ends in (c.encode(texts) for c in self.coders)))

    def unit_ids(self, units: list[str]) -> tuple[list, list]:
        """The ids of both sides of units as they stand in a text, behind their space or line feed."""
        a = [e.ids for e in self.coders[0].library.encode_batch_fast(units, add_special_tokens=False)]
        b = self.library.encode([u[1:] for u in units], num_threads=1)
        lines = [i for i, u in enumerate(units) if u[0] == "\n"]  # without the space that the library puts before a text
        for i, ids in zip(lines, self.coders[1].match([units[i] for i in lines])):
            b[i] = ids.tolist()
        return a, b

    def cut_ids(self, raw: list[bytes], a: list, b: list) -> "Cut":
        """The tokens of both sides, without those whose joined bytes are not the ``raw`` ones."""
        sides, good = [list(map(list, a)), list(map(list, b))], [bool(r) for r in raw]
        for coder, runs in zip(self.coders, sides):
            known = coder.bytes_of
            good = [g and b"".join([known[x] for x in run]) == r for g, run, r in zip(good, runs, raw)]
        ids, owners = [], []
        for runs in sides:
            runs = [run if g else () for g, run in zip(good, runs)]
            ids.append(np.array([x for run in runs for x in run], np.int64))
            owners.append(np.repeat(np.arange(len(raw)), [len(run) for run in runs]))
        return Cut(ids, owners, [np.cumsum(size[i]) for size, i in zip(self.sizes, ids)], np.array(good))


class Linked(NamedTuple):
    """What a unit or a text comes to: links that end together as pairs (A id << 32 | B id), and the rest by row."""

    pairs: np.ndarray
    n_links: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    listed: list[str]
    good: np.ndarray


class Units:
    """Links of distinct units. The first ``KEPT`` ones are kept for the life of a Python worker, so most of the frequent ones."""

    def __init__(self, sides: "Sides"):
        self.sides, self.rows, self.listed = sides, {}, []
        self.pairs, self.used = np.empty(1 << 16, np.int64), 0
        self.counts = np.empty((5, 1 << 14), np.int64)  # first link, links, tokens of A and of B, whether the bytes are the text's

    def _made(self, words: list[str]) -> Linked:
        made = []
        for x in range(0, len(words), 8_000):
            units = [w if w[:1] == "\n" else " " + w for w in words[x : x + 8_000]]
            made.append(self.sides.cut_ids([u.encode() for u in units], *self.sides.unit_ids(units)).linked(self.sides.decimals))
        return _joined(made)

    def _keep(self, words: list[str], new: Linked) -> None:
        old, more = len(self.rows), len(new.pairs)
        if self.used + more > len(self.pairs):
            self.pairs = np.concatenate([self.pairs[: self.used], np.empty(self.used // 2 + more, np.int64)])
        if old + len(words) > self.counts.shape[1]:
            self.counts = np.concatenate([self.counts[:, :old], np.empty((5, old // 2 + len(words)), np.int64)], 1)
        self.pairs[self.used : self.used + more] = new.pairs
        first = self.used + np.cumsum(new.n_links) - new.n_links
        self.counts[:, old : old + len(words)] = first, new.n_links, new.n_a, new.n_b, new.good
        self.listed += new.listed
        self.rows.update(zip(words, range(old, old + len(words))))
        self.used += more

    def of(self, words: list[str]) -> tuple[np.ndarray, Linked]:
        """Where each of the distinct ``words`` (cut at spaces and before line feeds) is in what follows; what they come to."""
        rows = np.fromiter((self.rows.get(w, -1) for w in words), np.int64, len(words))
        known, missing = np.flatnonzero(rows >= 0), np.flatnonzero(rows < 0)
        first, n_links, n_a, n_b, good = self.counts[:, rows[known]]
        at = np.repeat(first - np.cumsum(n_links) + n_links, n_links) + np.arange(n_links.sum())
        out = [Linked(self.pairs[at], n_links, n_a, n_b, [self.listed[r] for r in rows[known].tolist()], good.astype(bool))]
        if len(missing):
            new = [words[i] for i in missing.tolist()]
            out.append(self._made(new))
            if len(self.rows) + len(new) <= KEPT:
                self._keep(new, out[1])
        place = np.empty(len(words), np.int64)
        place[np.concatenate([known, missing])] = np.arange(len(words))
        return place, _joined(out)


def _joined(parts: list[Linked]) -> Linked:
    return Linked(*(sum(x, []) if isinstance(x[0], list) else np.concatenate(x) for x in zip(*parts)))


class Cut:
    """Tokens of two sides over the same bytes: ids, documents, and ends in the bytes of all documents."""

    def __init__(self, ids: list[np.ndarray], owners: list[np.ndarray], ends: list[np.ndarray], good: np.ndarray):
        self.ids, self.owners, self.ends, self.good, self.docs = ids, owners, ends, good, len(good)
        self.size = int(ends[0][-1]) if len(ends[0]) else 0
        #: offsets where tokens of both sides end, and the group of each token
        self.borders = np.intersect1d(*ends, assume_unique=True)
        self.groups = [np.searchsorted(self.borders, e) for e in ends]

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tokens of both sides that share bytes, and how many."""
        yield from row_products(token_bytes(self.ends[0], self.size), transposed(token_bytes(self.ends[1], self.size)))

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Tokens of both sides in the same group; the value is 1."""
        a, b = (token_groups(g, len(self.borders)) for g in self.groups)
        yield from row_products(a, transposed(b))

    def ending_together(self) -> tuple[np.ndarray, np.ndarray]:
        """Overlap links of tokens whose byte ranges end together."""
        parts = [(i[same], j[same]) for i, j, _ in self.overlaps() if len(same := np.flatnonzero(self.ends[0][i] == self.ends[1][j]))]
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def listed(self, decimals: list[str]) -> list[str]:
        """Of each document ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        (a, b), (g, h) = self.ids, self.groups
        # tokens of A stand before those of B of their group
        at_a = np.arange(len(a)) + np.searchsorted(h, g, "left")
        at_b = np.arange(len(b)) + np.searchsorted(g, h, "right")
        last = lambda group: np.concatenate([group[1:] != group[:-1], [True]]) if len(group) else np.empty(0, bool)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[at_a] = 3 * a + last(g)
        codes[at_b] = 3 * b + 2 * last(h)
        cut = np.concatenate([[0], np.cumsum(sum(np.bincount(o, minlength=self.docs) for o in self.owners))]).tolist()
        flat = codes.tolist()
        return ["".join([decimals[c] for c in flat[x:y]])[:-1] for x, y in zip(cut, cut[1:])]


    def linked(self, decimals: list[str]) -> Linked:
        i, j = self.ending_together()
        n_a, n_b = (np.bincount(o, minlength=self.docs) for o in self.owners)
        n_links = np.bincount(self.owners[0][i], minlength=self.docs)
        return Linked(self.ids[0][i] << 32 | self.ids[1][j], n_links, n_a, n_b, self.listed(decimals), self.good)


def token_links(docs: DataFrame, a: str, b: str, kind: str = "overlap", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a_at, b_at (places of tokens in their document), a_id, b_id and shared of all links of a ``kind``.

    ``overlap``: tokens that share bytes, ``shared`` being their number; ``group``: tokens of one group, ``shared`` being 1.
    """

    def run(batches):
        sides = Sides.of(a, b)
        for batch in steps(batches):
            cut = sides.cut(batch.column("text"))
            firsts = [np.concatenate([[0], np.cumsum(np.bincount(o, minlength=cut.docs))]) for o in cut.owners]
            for i, j, value in cut.overlaps() if kind == "overlap" else cut.shared():
                owner = cut.owners[0][i]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(owner)), pa.array(i - firsts[0][owner]), pa.array(j - firsts[1][owner]),
                     pa.array(cut.ids[0][i]), pa.array(cut.ids[1][j]), pa.array(value)],
                    ["doc_id", "a_at", "b_at", "a_id", "b_id", "shared"],
                )

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, a_at long, b_at long, a_id long, b_id long, shared long")


#: texts that are one unit: for either side odd, or not cut into the same units by both
WHOLE = f"{ODD}|{MARK}"
BLOCKS = (
    "block long, pairs binary, numbers binary, unit_links binary, links binary, more_links binary, units binary, more_units binary, "
    "doc_ids array<long>, n_units array<long>, n_a array<long>, n_b array<long>, n_links array<long>, digests array<string>"
)


def _packed(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers of which most are small: 16 bits each, and 32 more for each that is not below 65,535."""
    low = np.minimum(codes, 0xFFFF)
    return low.astype("<u2").tobytes(), (codes - 0xFFFF)[low == 0xFFFF].astype("<u4").tobytes()


def _unpacked(low: bytes, more: bytes) -> np.ndarray:
    codes = np.frombuffer(low, "<u2").astype(np.int64)
    codes[codes == 0xFFFF] += np.frombuffer(more, "<u4")
    return codes


def _by_frequency(number: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of falling ``counts``, and ``number`` renumbered by it."""
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return order, place[number]


def _runs(flat: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` (of ``sizes``) that are ``wanted``, one after another."""
    many = sizes[wanted]
    at = np.repeat((np.cumsum(sizes) - sizes)[wanted] - np.cumsum(many) + many, many) + np.arange(many.sum())
    return flat[at]


def link_blocks(docs: DataFrame, a: str, b: str, size: int = BLOCK_BYTES) -> DataFrame:
    """Links that end together, by blocks of documents: a row for each block.

    ``pairs``: the distinct pairs (A id << 32 | B id), ``numbers``: how often each is linked; ``unit_links``, ``links`` and
    ``more_links``: of each distinct unit how many links, and of these the numbers of their pairs; ``units`` and ``more_units``: of
    each unit of each document the number of the distinct one.
    """

    def run(batches):
        sides, part = Sides.of(a, b), TaskContext.get().partitionId()
        for done, batch in enumerate(steps(batches, limit=size)):
            texts = strings(batch.column("text"))
            filled = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            whole = pc.match_substring_regex(texts, WHOLE)
            plain = pc.if_else(whole, "", texts)
            words = pc.split_pattern(pc.replace_substring(plain, "\n", " \n") if sides.cut_lines else plain, " ")
            which, distinct = distinct_words(words.flatten())
            n_units = np.diff(words.offsets.to_numpy()).astype(np.int64)
            place, units = sides.units.of(distinct)
            which = place[which]
            odd = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
            if len(odd):  # of these texts the one empty unit becomes a unit of their own
                which[(np.cumsum(n_units) - n_units)[odd]] = len(distinct) + np.arange(len(odd))
                units = _joined([units, sides.cut(texts.take(pa.array(odd))).linked(sides.decimals)])
            cut = np.concatenate([[0], np.cumsum(n_units)])
            bad = np.diff(np.concatenate([[0], np.cumsum(~units.good[which])])[cut])
            good = filled & (bad == 0)
            # documents without tokens have no units
            which = which[np.repeat(good, n_units)]
            n_units = np.where(good, n_units, 0)
            cut = np.concatenate([[0], np.cumsum(n_units)])
            used, which, times = np.unique(which, return_inverse=True, return_counts=True)
            order, which = _by_frequency(which, times)
            used, times = used[order], times[order]
            links, n_links = _runs(units.pairs, units.n_links, used), units.n_links[used]
            pairs, link = np.unique(links, return_inverse=True)
            numbers = np.bincount(link, np.repeat(times, n_links), minlength=len(pairs)).astype(np.int64)
            order, link = _by_frequency(link, numbers)
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[used][which])])[cut])
            listed, at, cuts = [units.listed[u] for u in used.tolist()], which.tolist(), cut.tolist()
            joined = (";".join([listed[u] for u in at[x:y]]) for x, y in zip(cuts, cuts[1:]))
            digests = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in joined]
            lists = lambda x, t=pa.int64(): pa.array([x], pa.list_(t))
            blob = lambda x: pa.array([x], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | done]), blob(pairs[order].astype("<i8").tobytes()), blob(numbers[order].astype("<i8").tobytes()),
                    blob(n_links.astype("<u4").tobytes()), *map(blob, _packed(link)), *map(blob, _packed(which)),
                    lists(batch.column("doc_id").to_pylist()), lists(n_units), lists(total(units.n_a)), lists(total(units.n_b)),
                    lists(total(units.n_links)), lists(digests, pa.string()),
                ],
                [c.split()[0] for c in BLOCKS.split(", ")],
            )
            pa.default_memory_pool().release_unused()  # a worker outlives its task; what a block took goes back

    return map_batches(id_and_text(docs, id_col="doc_id", text_col="text"), run, BLOCKS)


def aligned(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES, held: HandOffs | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row.

    ``a``: a byte-level vocabulary, for a space and the text; ``b``: a SentencePiece model, for the text.
    """
    held = held or HandOffs()
    blocks = held.write(link_blocks(id_and_text(docs, id_col, text_col), a, b, size), "link-blocks")

    def pairs(batches):
        for batch in batches:
            for block, raw, numbers in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "numbers"))):
                of, n = np.frombuffer(raw, "<i8"), np.frombuffer(numbers, "<i8")
                for x in range(0, len(of), 1 << 16):
                    y = min(len(of), x + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(y - x, block)), pa.array(of[x:y]), pa.array(np.arange(x, y)), pa.array(n[x:y])], ["block", "pair", "at", "n"])

    entries = map_batches(blocks.select("block", "pairs", "numbers"), pairs, "block long, pair long, at long, n long")
    counts = held.write(entries.groupBy("pair").agg(F.sum("n").alias("links")), "pair-counts")
    side = F.col("pair").bitwiseAND((1 << 32) - 1)
    highest = counts.groupBy(side.alias("b_id")).agg(F.max("links").alias("most"))  # a row for each id of the B vocabulary
    counts = counts.withColumn("b_id", side).join(F.broadcast(highest), "b_id").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))
    known = entries.select("block", "pair", "at").join(counts.hint("shuffle_hash"), "pair").select("block", "at", "links", "best")

    def documents(key, known_, block_):
        if not block_.num_rows:
            return
        row = {c: block_.column(c)[0].as_py() for c in block_.column_names}
        at = known_.column("at").to_numpy()
        links, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        links[at], best[at] = known_.column("links").to_numpy(), known_.column("best").to_numpy(zero_copy_only=False)
        of_unit = np.concatenate([[0], np.cumsum(np.frombuffer(row["unit_links"], "<u4"), dtype=np.int64)])
        link, which = _unpacked(row["links"], row["more_links"]), _unpacked(row["units"], row["more_units"])
        cut = np.concatenate([[0], np.cumsum(row["n_units"], dtype=np.int64)])

        def summed(x):
            unit = np.diff(np.concatenate([[0], np.cumsum(x[link])])[of_unit])
            return pa.array(np.diff(np.concatenate([[0], np.cumsum(unit[which])])[cut]))

        n_links = pa.array(row["n_links"], pa.int64())  # where both sides end, one token of each does: as many groups as links
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[c], pa.int64()) for c in ("doc_ids", "n_a", "n_b")]
            + [n_links, n_links, summed(best), summed(links), pa.array(row["digests"], pa.string())],
            ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
        )

    def by_block(key, known_, block_):
        return pa.Table.from_batches(list(documents(key, known_, block_)), schema=out)

    out = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [("groups_sha256", pa.string())])
    grouped = known.groupBy("block").cogroup(blocks.drop("pairs", "numbers").groupBy("block"))
    return grouped.applyInArrow(
        by_block, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
