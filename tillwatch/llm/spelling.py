"""Spelling variants: words that one edit separates, found by composing the minimised vocabulary acceptor with a one-edit
transducer and the acceptor again.

1. ``vocabulary``: runs of letters are counted over all documents. Each task counts distinct words of bounded slices, so
   what is shuffled is a word and a number, however common the word is. A run whose checksum (of document and run) is a
   multiple of ``EVERY`` loses one letter, which stands for typing errors. Checksums of all occurrences are taken at once:
   crc32 is linear, so that of ``<doc_id>:<run>`` is that of ``<doc_id>:`` moved by the run's length, plus that of the run.
2. Composition, enumerated by partitions of initial states. Of two words one edit apart, the shorter of length ``n``, the
   edit lies behind the first ``n // 2`` letters or before the last ``n - n // 2``: they share one of these halves. So a
   level (``n``), a side and a half name an initial state that both words pass, and each word belongs to four: two as a
   word of length ``n``, two as one of length ``n + 1``. Inside a partition the rest of the words is an acceptor,
   minimised while it is built from sorted words, read backwards where the half is the end. The transducer has two
   states, before and after its edit. Before it, both acceptors read the same letter; the edit replaces a letter or
   reads one more on the longer side; after it, only strings that both accept go on. Nothing else is ever compared.
3. A partition of more than ``BLOCK`` words is cut into squares of two blocks each, every one an acceptor of its own, so
   a common half neither meets in one task nor grows an acceptor without bound.
4. A word's form is its near word of largest count, if that is ``RATIO`` times its own; roots follow forms by doubling
   steps. Counts grow by that ratio with each form, so chains are short and never closed.

Defined results: null and empty texts have no words; a null ``doc_id`` is the empty string in the checksum; repeated rows
count each; ties between near words go to the smallest in code-point order; empty tables give no rows; other columns are
ignored, whatever their names. Texts and words of any length are read whole: nothing recurses along a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.texts import map_batches, steps, strings
from tillwatch.session import HandOffs

#: what is not a letter of a word: all but A-Z, a-z and U+00C0 to U+00FF
GAP = r"[^A-Za-z\x{C0}-\x{FF}]+"
EVERY = 199
LETTERS, TIMES, RATIO = 6, 5, 5
#: words that one acceptor holds at most
BLOCK = 20_000
#: distinct words that a task counts before it hands them on
HELD = 400_000


class Shifts:
    """crc32 of a joined string from those of its parts: the first one moved by zero bytes as long as the second."""

    def __init__(self):
        digests = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
        one = np.zeros((4, 256), np.uint32)  # by byte of a state: what a zero byte makes of it
        for k in range(4):
            one[k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k) >> np.uint32(8)
        one[0] ^= digests ^ digests[0]
        self.by_power = [one]

    @staticmethod
    def apply(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
        out = tables[0][state & np.uint32(255)]
        for k in (1, 2, 3):
            out = out ^ tables[k][(state >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def moved(self, states: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each state moved by its number of zero bytes."""
        out, bit = states.copy(), 0
        while (lengths >> bit).any():  # one table for each power of two
            if bit == len(self.by_power):
                self.by_power.append(self.apply(self.by_power[-1], self.by_power[-1]))
            at = np.flatnonzero((lengths >> bit) & 1)
            out[at] = self.apply(self.by_power[bit], out[at])
            bit += 1
        return out


def word_counts(docs: DataFrame, every: int = EVERY, least: int = LETTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n, in parts, of all words of at least ``least`` letters."""

    def run(batches):
        shifts, held = Shifts(), {}

        def flushed():
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for batch in steps(batches):
            lists = pc.split_pattern_regex(pc.ascii_lower(strings(batch.column("text"))), GAP)
            flat = lists.flatten()
            long_ = pc.greater_equal(pc.utf8_length(flat), least).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))[long_]
            coded = flat.filter(pa.array(long_)).dictionary_encode()
            codes, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
            raw = [w.encode() for w in words]
            prefix = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in batch.column("doc_id").to_pylist()], np.uint32)
            sums = np.array([zlib.crc32(r) for r in raw], np.uint32)
            sizes = np.array([len(r) for r in raw], np.int64)
            digest = shifts.moved(prefix[owner], sizes[codes]) ^ sums[codes]
            hit = np.flatnonzero(digest % np.uint32(every) == 0)
            counts = np.bincount(codes, minlength=len(words)) - np.bincount(codes[hit], minlength=len(words))
            for w, n in zip(words, counts.tolist()):
                if n:
                    held[w] = held.get(w, 0) + n
            for code, h in zip(codes[hit].tolist(), digest[hit].tolist()):
                w = words[code]
                at = h % len(w)
                if len(w) > least:
                    w = w[:at] + w[at + 1 :]
                    held[w] = held.get(w, 0) + 1
            if len(held) > HELD:
                yield flushed()
        if held:
            yield flushed()

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(slim, run, "word string, n long")


class Acceptor:
    """Minimal acyclic acceptors with any number of initial states; states are shared between them.

    State 0 accepts the empty string and nothing else. A state is its arcs; equal states are one.
    """

    def __init__(self):
        self.arcs: list[dict[str, int]] = [{}]
        self.known: dict[tuple, int] = {}

    def _state(self, arcs: dict[str, int]) -> int:
        key = tuple(arcs.items())
        if not key:
            return 0
        if (found := self.known.get(key)) is None:
            found = self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
        return found

    def initial(self, words: list[str]) -> int:
        """The initial state of the sorted distinct ``words``, all of one length."""
        path: list[dict[str, int]] = [{}]
        letters, before = [], ""
        for word in [*words, None]:
            keep = 0
            if word is not None:
                while keep < len(before) and before[keep] == word[keep]:
                    keep += 1
            while len(letters) > keep or (word is None and letters):
                done = self._state(path.pop())
                path[-1][letters.pop()] = done
            if word is not None:
                for c in word[keep:]:
                    letters.append(c)
                    path.append({})
                before = word
        return self._state(path[0])

    def common(self, p: int, q: int) -> Iterator[str]:
        """Strings that both states accept."""
        stack = [(p, q, "")]
        while stack:
            p, q, read = stack.pop()
            if not p and not q:
                yield read
                continue
            other = self.arcs[q]
            for c, r in self.arcs[p].items():
                if (s := other.get(c)) is not None:
                    stack.append((r, s, read + c))

    def replaced(self, p: int, q: int) -> Iterator[tuple[str, str]]:
        """Strings of ``p`` and ``q`` that differ by one replaced letter; each pair once where ``p`` is ``q``."""
        once, stack = p == q, [(p, q, "")]
        while stack:
            p, q, read = stack.pop()
            left, right = self.arcs[p], self.arcs[q]
            for a, r in left.items():
                for b, s in right.items():
                    if a == b:
                        stack.append((r, s, read + a))
                    elif not once or a < b:
                        for rest in self.common(r, s):
                            yield read + a + rest, read + b + rest

    def inserted(self, p: int, q: int) -> Iterator[tuple[str, str]]:
        """Strings of ``p`` and those of ``q`` that have one letter more; a pair once, by the last place that it fits."""
        stack = [(p, q, "")]
        while stack:
            p, q, read = stack.pop()
            left = self.arcs[p]
            for b, s in self.arcs[q].items():
                if b in left:
                    stack.append((left[b], s, read + b))
                for rest in self.common(p, s):
                    if rest[:1] != b:
                        yield read + rest, read + b + rest


def composed(short: list[str], other: list[str], longer: list[str], same: bool, ordered: bool) -> Iterator[tuple[str, str]]:
    """Pairs that one edit separates: ``short`` with ``other`` (both of one length, if ``ordered``) and with ``longer``.

    ``same``: ``other`` is ``short``. Each pair comes once.
    """
    acceptor = Acceptor()
    p = acceptor.initial(sorted(short)) if short else None
    if p is None:
        return
    if ordered and other:
        yield from acceptor.replaced(p, p if same else acceptor.initial(sorted(other)))
    if longer:
        yield from acceptor.inserted(p, acceptor.initial(sorted(longer)))


def _entries(words: DataFrame, least: int) -> DataFrame:
    """Of each word its four partitions: level, back (whether the half is the end), half, and whether it is the longer one."""
    m = F.col("m")

    def at(level, back: bool, longer: bool):
        front = F.floor(level / 2).cast("int")
        half = F.substring(F.col("word"), m - (level - front) + 1, level - front) if back else F.substring(F.col("word"), F.lit(1), front)
        return F.struct(level.cast("int").alias("level"), F.lit(back).alias("back"), half.alias("half"), F.lit(longer).alias("longer"))

    here = [at(m, back, False) for back in (False, True)]
    below = [at(m - 1, back, True) for back in (False, True)]
    spread = F.explode(F.when(m > least, F.array(*here, *below)).otherwise(F.array(*here)))
    return words.withColumn("m", F.length("word")).select("word", "n", spread.alias("at")).select("word", "n", "at.*")


def near_words(words: DataFrame, least: int = LETTERS, block: int = BLOCK) -> DataFrame:
    """word, near, near_n: for each of the ``words`` (word, n) all words one edit away."""

    def run(batches):
        place, rows = None, []

        def pairs():
            (level, back, half, x, y) = place
            if len(rows) < 2:
                return
            counts = {w: n for w, n, _, _ in rows}
            cut = len(half)
            # the half is common, so acceptors read the rest; backwards where it stands before the half
            rest = (lambda w: w[: len(w) - cut][::-1]) if back else (lambda w: w[cut:])
            whole = (lambda r: r[::-1] + half) if back else (lambda r: half + r)
            short = [rest(w) for w, _, longer, mine in rows if not longer and mine == x]
            other = [rest(w) for w, _, longer, mine in rows if not longer and mine == y]
            longer_ = [rest(w) for w, _, longer, _ in rows if longer]
            front = level // 2
            for a, b in composed(short, other, longer_, x == y, x <= y):
                a, b = whole(a), whole(b)
                if back and a[:front] == b[:front]:
                    continue  # they share the other half as well, and were found there
                yield a, b, counts[b]
                yield b, a, counts[a]

        def out(found):
            a, b, n = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])

        found: list[tuple] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("level", "back", "half", "x", "y", "word", "n", "longer", "mine")]
            for level, back, half, x, y, *row in zip(*columns):
                if (level, back, half, x, y) != place:
                    if place:
                        found.extend(pairs())
                    place, rows = (level, back, half, x, y), []
                    if len(found) > 20_000:
                        yield out(found)
                        found = []
                rows.append(row)
        if place:
            found.extend(pairs())
        if found:
            yield out(found)

    key = ["level", "back", "half"]
    entries = _entries(words, least)
    large = entries.groupBy(*key).count().where(F.col("count") > block).select(*key, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = entries.join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.hash("word"), F.col("blocks")))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    square = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    down, across = F.transform(every, lambda x: square(x, F.col("mine"))), F.transform(every, lambda y: square(F.col("mine"), y))
    squares = F.explode(F.when(F.col("longer"), down).otherwise(F.array_union(down, across)))
    dealt = dealt.withColumn("at", squares).select(*key, "at.x", "at.y", "word", "n", "longer", "mine")
    dealt = dealt.repartition(*key, "x", "y").sortWithinPartitions(*key, "x", "y")
    return map_batches(dealt, run, "word string, near string, near_n long")


def roots(forms: DataFrame, held: HandOffs) -> DataFrame:
    """word and root, the last word that forms lead to, of all words that have a form (word, form)."""
    steps_ = held.write(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = steps_.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = held.write(
            steps_.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")),
            "roots",
        )
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        steps_ = moved.select("word", "root")


def spelling_forms(
    docs: DataFrame, every: int = EVERY, least: int = LETTERS, times: int = TIMES, ratio: int = RATIO,
    id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, held: HandOffs | None = None,
) -> DataFrame:
    """word, n, form, root, n_near and form_n of every word of the documents."""
    held = held or HandOffs()
    words = word_counts(docs, every, least, id_col, text_col).groupBy("word").agg(F.sum("n").alias("n"))
    words = held.write(words.where(F.col("n") >= times), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(words, least, block).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    strong = -F.col("best.less") >= ratio * F.col("n")
    joined = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"),
    )
    joined = held.write(joined, "word-forms")
    ends = roots(joined.where("form IS NOT NULL"), held)
    return joined.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
