"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both encodings must agree.

A text longer than a chunk is encoded in chunks that overlap. Two neighbours are spliced at a boundary that is common
and proven stable: a place inside the overlap, right behind white space, at which a token starts in both encodings.
The pre-tokenizer drops white space and no pre-token, merge or added token crosses it, so neither what a chunk cuts off
before nor what it cuts off behind can change the tokens beyond that place. Where an overlap holds no such place (a run
without white space), the overlap is widened, twice as far each time; if the whole chunk holds none, it is joined with
the next one.

Shorter texts are cut at all of their white space for the same reason, and each distinct word of a worker goes through
the library once. Texts with added tokens in them go through it whole, or in chunks.

Null texts are empty and have no tokens; a null ``doc_id`` stays null; each row gives a row, repeated ones too; empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tillwatch.llm.texts import Runs, distinct_words, id_and_text, map_batches, steps, strings

#: characters of a chunk and of the first overlap
CHUNK, OVERLAP = 65_536, 512


class Splicer:
    """Encoder for one vocabulary whose pre-tokenizer drops white space; one per Python worker."""

    _made: dict[str, "Splicer"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words = Runs(self._counts, np.int32)

    @classmethod
    def of(cls, path: str) -> "Splicer":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _counts(self, words: list[str]) -> list[list[int]]:
        return [[len(e.ids)] for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _chunk(self, text: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``text[a:b]`` and where each token starts in ``text``."""
        got = self.library.encode(text[a:b], add_special_tokens=False)
        return np.array(got.ids, np.int64), np.array([s for s, _ in got.offsets], np.int64) + a

    @staticmethod
    def _stable(text: str, left: np.ndarray, right: np.ndarray, a: int, b: int) -> int:
        """The last place in ``[a, b)`` behind white space at which both start a token, -1 if there is none."""
        both = np.intersect1d(left, right)
        for at in both[(both > a) & (both < b)][::-1].tolist():
            if text[at - 1] in " \t\n\x0b\x0c\r":
                return at
        return -1

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], int, int]:
        """Ids of a text of any length, the chunks it took, and how often an overlap was widened."""
        parts, a, b = [], 0, min(chunk, len(text))
        ids, starts = self._chunk(text, a, b)
        chunks, widened = 1, 0
        while b < len(text):
            wide, end = overlap, min(len(text), b + chunk)
            while True:
                begin = max(a, b - wide)
                if begin == a:  # nothing left to widen: the chunk is joined with the next
                    ids, starts = self._chunk(text, a, end)
                    break
                more, more_starts = self._chunk(text, begin, end)
                chunks += 1
                # a start that the cut itself made is no boundary of the text
                cut = self._stable(text, starts, more_starts, begin, b)
                if cut >= 0:
                    parts.append(ids[starts < cut])
                    ids, starts, a = more[more_starts >= cut], more_starts[more_starts >= cut], cut
                    break
                wide, widened = 2 * wide, widened + 1
            b = end
        parts.append(ids)
        return np.concatenate(parts).tolist(), chunks, widened

    def count(self, texts: pa.Array, chunk: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its tokens, chunks and widened overlaps."""
        texts = strings(texts)
        odd = pc.or_(pc.greater(pc.utf8_length(texts), chunk), pc.match_substring(texts, "<|"))
        some = odd.true_count > 0
        words = pc.ascii_split_whitespace(pc.if_else(odd, "", texts) if some else texts)
        each, _ = self.words.expand(*distinct_words(words.flatten()))
        upto = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        cut = words.offsets.to_numpy()
        tokens = np.diff(upto[cut - cut[0]])
        chunks, widened = np.ones(len(texts), np.int32), np.zeros(len(texts), np.int32)
        if some:
            at = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            for i, text in zip(at, texts.take(pa.array(at)).to_pylist()):
                ids, chunks[i], widened[i] = self.encode(text, chunk, overlap)
                tokens[i] = len(ids)
        return tokens, chunks, widened


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, chunks, widened for each row of ``docs``."""

    def count(batches):
        splicer = Splicer.of(path)
        for batch in steps(batches):
            texts = batch.column("text")
            tokens, chunks, widened = splicer.count(texts, chunk, overlap)
            size = pc.cast(pc.binary_length(texts), pa.int64())
            columns = [batch.column("doc_id"), size, tokens, tokens > limit, chunks, widened]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "chunks", "widened"]
    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chunks int, widened int"
    return map_batches(id_and_text(docs), count, schema)
