"""Byte-level BPE ids of whole texts, as the ``tokenizers`` library gives them.

The pre-tokenizer never joins what a single space or line feed separates, if neither neighbour is white space. Texts
in which all white space is like that are cut there, and each distinct unit of a worker goes through the library once;
any other text goes through it whole.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tillwatch.llm.texts import Runs, distinct_words, strings

#: white space beside a line feed or space, at an end, or of another kind; added tokens; the mark of a text's start
ODD = (
    r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\v\f\r\x{01}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
    r"\x{3000}]|<\|"
)
#: units that the library gets as one text
JOINED = 64


class ByteBpe:
    """Encoder for one vocabulary file; one per Python worker."""

    _made: dict[str, "ByteBpe"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        # the pre-tokenizer shows bytes as characters: itself if it prints, else the next one from 256 on
        as_shown = {b: chr(256 + n) for n, b in enumerate(hidden)}
        self.as_shown = "".join(as_shown.get(b, chr(b)) for b in range(256))
        vocabulary = self.library.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token[:1] in (self.as_shown[32], self.as_shown[10])]] = True
        self.units = Runs(self._units)

    @classmethod
    def of(cls, path: str) -> "ByteBpe":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _units(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, each with its space or line feed, one after another, and how many each has.

        ``JOINED`` units go through the library as one text. A unit begins where an id begins with a space or line feed,
        as nothing else in it does; what begins a text gets a line feed, whose id is taken out again.
        """
        texts = [" " + " ".join(words[a : a + JOINED]) for a in range(0, len(words), JOINED)]
        texts = [t.replace(" \n", "\n").replace(" \x01", "\n") for t in texts]
        got = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(got), np.uint32, sum(map(len, got)))
        first = np.flatnonzero(self.begins[ids])
        if len(first) != len(words):
            raise ValueError("units were not told apart")
        sizes = np.diff(first, append=len(ids))
        begin = np.array([k for k, w in enumerate(words) if w[:1] == "\x01"], np.int64)
        sizes[begin] -= 1
        return np.delete(ids, first[begin]), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids end."""
        texts = strings(texts)
        odd = pc.match_substring_regex(texts, ODD)
        plain = pc.if_else(odd, "", texts) if odd.true_count else texts
        marked = pc.binary_join_element_wise(pa.scalar("\x01"), pc.replace_substring(plain, "\n", " \n"), "")
        words = pc.split_pattern(marked, " ")
        ids, ends = self.units.expand(*distinct_words(words.flatten()))
        ends = np.concatenate([[0], ends])[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]
        if odd.true_count:
            parts = np.split(ids, ends[:-1])
            at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            whole = texts.take(pa.array(at)).to_pylist()
            for i, text in zip(at, whole):
                parts[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends
