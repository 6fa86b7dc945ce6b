"""SentencePiece encoding by suffix-array matching, and decoding.

The units of a batch (what no piece can cross: a run of word marks and the characters up to the next one) are taken
once each and concatenated. All suffixes are sorted by their first characters, as many as the longest piece has. Every
piece is then found by binary search: its occurrences are one range of the suffix array. The occurrences are edges from
where a piece begins to where it ends; they are sorted by position, and relaxed: over all units at once, the edge of
the best score whose two halves are symbols of the current segmentation becomes one symbol, the leftmost among equals,
until no unit has such an edge. For a BPE model that is its definition, so the ids are the library's.

Characters outside the vocabulary become byte pieces, as in the model. Decoding joins pieces and bytes and turns word
marks into spaces.

Null texts are empty; an empty text has no ids and decodes to an empty text. A null ``doc_id`` stays null; repeated
rows are encoded like any other; empty tables give no rows. Text with the word mark itself (U+2581) or bytes that are
no UTF-8 decodes to something else, as in the library: the mark is its space. Very long texts are cut into units, and
a very long unit is relaxed by a heap in n log n.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.texts import Runs, crc32, distinct_words, id_and_text, map_batches, steps, strings

MARK = "▁"
UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: characters of units that one suffix array indexes, unless one unit is longer
INDEXED = 1 << 18
#: text bytes that are encoded and decoded at once
STEP = 2 << 20
#: words whose pieces a worker keeps
KNOWN = 200_000
#: units longer than this are relaxed by a heap
LONG_UNIT = 256
#: texts that the plain cut at single spaces and line feeds doesn't fit
ODD = rf"^[ \n]| $|  |\x{{01}}|{MARK}"


class Pieces:
    """One BPE model as sorted tables; one per Python worker."""

    _made: dict[str, "Pieces"] = {}

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as formats

        model = formats.ModelProto()
        model.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=path).serialized_model_proto())
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte pieces is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("a model that leaves text as it is, but for the word marks, is needed")
        normal = [(p.piece, i, p.score) for i, p in enumerate(model.pieces) if p.type == 1]
        if any(MARK in p.lstrip(MARK) for p, _, _ in normal):
            raise ValueError("a piece crosses the beginning of a word")
        self.bytes_of = [b"" for _ in model.pieces]
        self.byte_id = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 1:
                self.bytes_of[i] = p.piece.replace(MARK, " ").encode()
        self.single = {p: i for p, i, _ in normal if len(p) == 1}
        self.alphabet = np.unique(np.array([ord(c) for p, _, _ in normal for c in p], np.uint32))
        self.single_id = np.full(len(self.alphabet) + 1, -1, np.int64)  # by code; 0: outside the alphabet
        for c, i in self.single.items():
            self.single_id[np.searchsorted(self.alphabet, ord(c)) + 1] = i
        longer = [x for x in normal if len(x[0]) > 1]
        longer.sort(key=lambda x: (-x[2], x[1]))
        self.ids = np.array([i for _, i, _ in longer], np.int64)  # in the order of merging
        self.lengths = np.array([len(p) for p, _, _ in longer], np.int64)
        self.columns = -(-int(self.lengths.max()) // 4)
        codes = np.zeros((len(longer), 4 * self.columns), np.uint64)
        for row, (p, _, _) in enumerate(longer):
            codes[row, : len(p)] = np.searchsorted(self.alphabet, [ord(c) for c in p]) + 1
        self.low = self._packed(codes)
        codes[np.arange(codes.shape[1]) >= self.lengths[:, None]] = 0xFFFF
        self.high = self._packed(codes)
        self.joins_line = any("\n" in p for p, _, _ in normal)
        self.units = Runs(self._plain_units, most=KNOWN)

    @classmethod
    def of(cls, path: str) -> "Pieces":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @staticmethod
    def _packed(codes: np.ndarray) -> list[np.ndarray]:
        """Columns of four characters each, 16 bits a character, so that numbers sort like text."""
        c = codes.astype(np.uint64)
        return [c[:, k] << 48 | c[:, k + 1] << 32 | c[:, k + 2] << 16 | c[:, k + 3] for k in map(np.uint64, range(0, c.shape[1], 4))]

    # --- matching

    def _suffixes(self, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffix array by the first characters, and the packed characters in its order."""
        padded = np.concatenate([codes, np.zeros(4 * self.columns + 4, np.uint64)])
        n = len(codes)
        packed = padded[:-3] << np.uint64(48) | padded[1:-2] << np.uint64(32) | padded[2:-1] << np.uint64(16) | padded[3:]
        begins = np.flatnonzero(codes)
        keys = [packed[begins + 4 * k] for k in range(self.columns)]
        order = np.lexsort(keys[::-1])
        return begins[order], [k[order] for k in keys]

    def _bound(self, keys: list[np.ndarray], want: list[np.ndarray], rows: np.ndarray, right: bool, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """By binary search in ``[lo, hi)``: how many suffixes are below (or, ``right``, not above) each wanted row."""
        lo, hi = lo.copy(), hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            at = np.minimum(mid, len(keys[0]) - 1)
            less, same = np.zeros(len(rows), bool), np.ones(len(rows), bool)
            for k, w in zip(keys, want):
                have, target = k[at], w[rows]
                less |= same & (have < target)
                same &= have == target
            up = open_ & (less | same if right else less)
            lo, hi = np.where(up, mid + 1, lo), np.where(open_ & ~up, mid, hi)
        return lo

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and rank of all occurrences of pieces of several characters, sorted by position."""
        suffixes, keys = self._suffixes(codes)
        first = np.searchsorted(keys[0], self.low[0], "left")
        last = np.searchsorted(keys[0], self.high[0], "right")
        deep = np.flatnonzero((self.lengths > 4) & (first < last))
        lo = self._bound(keys, self.low, deep, False, first[deep], last[deep])
        hi = self._bound(keys, self.high, deep, True, first[deep], last[deep])
        first[deep], last[deep] = lo, hi
        count = np.maximum(last - first, 0)
        found = np.flatnonzero(count)
        ranks = np.repeat(found, count[found])
        ends = np.cumsum(count[found])
        at = np.arange(len(ranks)) + np.repeat(first[found] - ends + count[found], count[found])
        begins = suffixes[at]
        order = np.argsort(begins, kind="stable")
        return begins[order], ranks[order]

    # --- relaxing

    def _relax(self, n: int, unit: np.ndarray, begins: np.ndarray, ranks: np.ndarray, piece: np.ndarray, after: np.ndarray, alive: np.ndarray) -> None:
        """Merges of all units at once; ``piece`` and ``after``: of each symbol's first place its id and where it ends."""
        s, e, r, u = begins, begins + self.lengths[ranks], ranks, unit[begins]
        open_unit = np.zeros(int(unit.max()) + 2 if len(unit) else 1, bool)
        while len(s):
            ready = np.flatnonzero(after[np.minimum(after[s], n - 1)] == e)
            if not len(ready):
                break
            owner, key = u[ready], r[ready] << 32 | s[ready]
            groups = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(key, groups)
            at, rank = best & 0xFFFFFFFF, best >> 32
            alive[after[at]] = False
            after[at] = at + self.lengths[rank]
            piece[at] = self.ids[rank]
            open_unit[:] = False
            open_unit[owner[groups]] = True
            keep = alive[s] & open_unit[u] & (after[s] < e)
            keep &= alive[np.minimum(e, n - 1)] | (e == n)
            s, e, r, u = s[keep], e[keep], r[keep], u[keep]

    def _relax_long(self, a: int, b: int, begins: np.ndarray, ranks: np.ndarray, piece: np.ndarray, after: np.ndarray, alive: np.ndarray) -> None:
        """The same for one long unit ``[a, b)``, by a heap of the edges that are ready."""
        edge = dict(zip(zip(begins.tolist(), (begins + self.lengths[ranks]).tolist()), ranks.tolist()))
        nxt, prev = list(range(1, b - a + 1)), list(range(-1, b - a - 1))
        heap = [(edge[a + i, a + i + 2], i, i + 1, i + 2) for i in range(b - a - 1) if (a + i, a + i + 2) in edge]
        heapq.heapify(heap)
        while heap:
            rank, i, m, e = heapq.heappop(heap)
            if nxt[i] != m or m >= b - a or nxt[m] != e:
                continue
            nxt[i], nxt[m] = e, -1
            alive[a + m] = False
            after[a + i], piece[a + i] = a + e, self.ids[rank]
            if e < b - a:
                prev[e] = i
                if (more := edge.get((a + i, a + nxt[e]))) is not None:
                    heapq.heappush(heap, (more, i, e, nxt[e]))
            if (p := prev[i]) >= 0 and (more := edge.get((a + p, a + e))) is not None:
                heapq.heappush(heap, (more, p, i, e))

    def match(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit."""
        out: list[np.ndarray] = []
        sizes = [len(u) for u in units]
        a = total = 0
        for b in range(len(units) + 1):
            if b == len(units) or (total and total + sizes[b] > INDEXED):
                out += self._match(units[a:b]) if b > a else []
                a, total = b, 0
            total += sizes[b] + 1 if b < len(units) else 0
        return out

    def _match(self, units: list[str]) -> list[np.ndarray]:
        joined = "\0".join(units) + "\0"  # a place of code 0 behind each unit; a NUL of a text has code 0 as well
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.searchsorted(self.alphabet, chars)
        codes = np.where(self.alphabet[np.minimum(codes, len(self.alphabet) - 1)] == chars, codes + 1, 0).astype(np.uint64)
        sizes = np.array([len(u) for u in units], np.int64)
        ends = np.cumsum(sizes + 1) - 1  # the separators
        unit = np.repeat(np.arange(len(units)), sizes + 1)
        n = len(codes)
        after, alive = np.arange(1, n + 1), np.ones(n, bool)
        piece = self.single_id[codes.astype(np.int64)]
        begins, ranks = self._edges(codes)
        long_ = np.flatnonzero(sizes > LONG_UNIT)
        if len(long_):
            mine = np.isin(unit[begins], long_)
            for k in long_.tolist():
                a, b = int(ends[k] - sizes[k]), int(ends[k])
                x, y = np.searchsorted(begins, [a, b])
                self._relax_long(a, b, begins[x:y], ranks[x:y], piece, after, alive)
            begins, ranks = begins[~mine], ranks[~mine]
        self._relax(n, unit, begins, ranks, piece, after, alive)
        alive[ends] = False
        at = np.flatnonzero(alive)
        ids = piece[at]
        count = np.ones(len(at), np.int64)
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            as_bytes = [[self.byte_id[x] for x in chr(c).encode("utf-8", "replace")] for c in chars[at[unknown]].tolist()]
            count[unknown] = [len(x) for x in as_bytes]
            ids, where = np.repeat(ids, count), np.cumsum(count) - count
            for i, x in zip(where[unknown].tolist(), as_bytes):
                ids[i : i + len(x)] = x
        owner = np.repeat(unit[at], count)
        return np.split(ids.astype(np.uint32), np.searchsorted(owner, np.arange(1, len(units))))

    def _plain_units(self, words: list[str]) -> list[np.ndarray]:
        """Of words as cut from plain texts: a line feed stands for itself, any other word follows a word mark."""
        return self.match(["" if w == "\x01" else w if w[:1] == "\n" else MARK + w.lstrip("\x01") for w in words])

    # --- texts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids end."""
        texts = strings(texts)
        odd = pc.match_substring_regex(texts, ODD)
        plain = pc.if_else(odd, "", texts) if odd.true_count else texts
        marked = pc.binary_join_element_wise(pa.scalar("\x01"), plain, "")
        if not self.joins_line:
            marked = pc.replace_substring(marked, "\n", " \n")
        words = pc.split_pattern(marked, " ")
        ids, ends = self.units.expand(*distinct_words(words.flatten()))
        ends = np.concatenate([[0], ends])[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]
        if odd.true_count:
            parts = np.split(ids, ends[:-1])
            at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            for i, text in zip(at, texts.take(pa.array(at)).to_pylist()):
                units = UNITS.findall(MARK + text.replace(" ", MARK))
                parts[i] = np.concatenate(self.match(units))
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and ``ids`` (array of int) of each row; the model is a parameter."""

    def run(batches):
        pieces = Pieces.of(model)
        for batch in steps(batches):
            ids, ends = pieces.encode(batch.column("text"))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), lists], ["doc_id", "text", "ids"])

    return map_batches(id_and_text(docs, id_col, text_col), run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the text of the ids; null ids decode to an empty text."""

    def run(batches):
        pieces = Pieces.of(model)
        for batch in batches:
            lists = pc.fill_null(batch.column("ids_"), pa.scalar([], pa.list_(pa.int32())))
            flat, cut = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            texts = [pieces.decode(flat[a:b].tolist()) for a, b in zip(cut, cut[1:])]
            rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "ids_"]
            yield pa.RecordBatch.from_arrays([*rest, batch.column("ids_"), pa.array(texts, pa.string())], names)

    rest = [c for c in encoded.columns if c not in (ids_col, "decoded")]
    names = [*rest, ids_col, "decoded"]
    shaped = encoded.select(*rest, F.col(ids_col).alias("ids_"))
    kinds = dict(encoded.dtypes)
    return map_batches(shaped, run, ", ".join(f"`{c}` {kinds[c]}" for c in [*rest, ids_col]) + ", decoded string")


def round_trips(
    docs: DataFrame, model: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", carry: str | None = None
) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian 32-bit integers), round_trip and, if wanted, ids.

    Encoding and decoding in one pass: ids go from one to the other inside a task, a bounded slice of texts at a time.
    ``round_trip`` says whether the ids decode to the text; ``carry`` names a column of numbers that comes along.
    """

    def run(batches):
        pieces = Pieces.of(model)
        pieces.units.alone()
        for batch in steps(batches, limit=STEP):
            ids, ends = pieces.encode(batch.column("text"))
            cut = np.concatenate([[0], ends]).astype(np.int64)
            parts = [ids[a:b] for a, b in zip(cut, cut[1:])]
            same = [pieces.decode(p.tolist()) == t for p, t in zip(parts, batch.column("text").to_pylist())]
            columns = [batch.column("doc_id"), pa.array(np.diff(cut)), pa.array([crc32(p) for p in parts], pa.int64()), pa.array(same, pa.bool_())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids.astype(np.int32))))
            if carry:
                columns.append(batch.column("carried"))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_pieces", "ids_crc32", "round_trip", *(["ids"] if with_ids else []), *([carry] if carry else [])]
    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    slim = id_and_text(docs, id_col, text_col)
    if carry:
        slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(carry).cast("double").alias("carried"))
        schema += f", `{carry}` double"
    return map_batches(slim, run, schema)
