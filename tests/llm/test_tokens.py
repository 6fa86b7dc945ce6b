import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from brute import ODD_TEXTS
from tillwatch.llm import byte_bpe, resync, suffix_pieces, token_links, wavelet
from tillwatch.llm.texts import Runs

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
HARD = ODD_TEXTS + [
    "\n\nx \n y\t", "<|endoftext|> hi <|endof", "don't 's \x01x", "  lead", "tr ", "é x̀", "a\x85b", "1234 5,6 don't!!",
    "x\x1cy \x1d z", "\nabc", "abc\n", "a\x00b ▁ ▁▁x", " " * 27 + "q", "thequickbrownfoxjumps" * 40, "漢字テキスト" * 80,
    "ΣΑΣ ΣΑΣ.", "ﬁ Ａ‍😀", "a \nb", "a\n b", "-----" * 30 + "====" * 9, "İstanbul",
]


@pytest.fixture(scope="module")
def texts(rows):
    return HARD + [t for _, t in rows]


def test_pieces_equal_the_library(texts):
    model, library = suffix_pieces.Pieces(PIECE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    ids, ends = model.encode(pa.array(texts, pa.string()))
    for text, got in zip(texts, np.split(ids, ends[:-1])):
        want = library.encode(text or "")
        assert got.tolist() == want
        assert model.decode(want) == library.decode(want)


def test_piece_columns(spark, odd, none):
    got = suffix_pieces.decode(suffix_pieces.encode(odd, PIECE), PIECE).collect()
    assert len(got) == odd.count() and all(r.decoded == r.text for r in got)
    assert suffix_pieces.encode(none, PIECE).count() == 0
    trips = {r.doc_id: r for r in suffix_pieces.round_trips(odd, PIECE).collect()}
    assert all(r.round_trip and r.n_pieces == len(r.ids) == len(e.ids) for e in got for r in [trips[e.doc_id]] if e.doc_id != 4)
    assert trips[9].ids_crc32 == zlib.crc32(np.array(trips[9].ids, "<u4")) and suffix_pieces.round_trips(none, PIECE).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [259])], "doc_id long, ids array<int>")
    assert sorted((r.doc_id, r.decoded) for r in suffix_pieces.decode(nulls, PIECE).collect())[0] == (1, "")


def test_new_units_go_through_the_library_together(texts):
    class Counted:
        def __init__(self, library):
            self.library, self.texts = library, 0

        def encode_batch_fast(self, batch, **how):
            self.texts += len(batch)
            return self.library.encode_batch_fast(batch, **how)

        def encode(self, text, **how):
            return self.library.encode(text, **how)

    rng = random.Random(4)
    marks = ["a", "B", "é", "漢", "1", "'s", "'", "'ll", "\n", " ", " ", "...", "<", "_", "😀", "\x01", "\t", "\xa0"]
    mixed = ["".join(rng.choices(marks, k=rng.randrange(12))) for _ in range(5000)]
    encoder, library = byte_bpe.ByteBpe(BYTE), Tokenizer.from_file(BYTE)
    encoder.library = counted = Counted(encoder.library)
    plain = " ".join(f"{x}{y}{z}{mark}" for x in "abcde" for y in "aeiou" for z in "rstvw" for mark in ("", ".", "ß!"))
    for some in ([plain], texts + mixed + ["", None, "'s", "\n's x"]):
        ids, ends = encoder.encode(pa.array(some, pa.string()))
        for text, got in zip(some, np.split(ids, ends[:-1])):
            assert got.tolist() == library.encode(text or "", add_special_tokens=False).ids
        if some == [plain]:
            assert counted.texts == -(-375 // byte_bpe.JOINED)
    spaced = token_links.SpacedBytes(BYTE)
    ids, ends = spaced.encode(pa.array(mixed))
    for text, got in zip(mixed, np.split(ids, ends[:-1])):
        assert got.tolist() == spaced.library.encode(" " + text, add_special_tokens=False).ids


def test_known_words_stay_bounded():
    table = Runs(lambda ws: (np.array([int(w) for w in ws for _ in range(int(w) % 3)], np.uint32), np.array([int(w) % 3 for w in ws])), most=10)
    for some in ([1, 2, 3], [3, 4, 5, 6], [2, 7, 8, 9, 10, 11], [2, 11, 1], list(range(30, 50)), [30, 1, 50]):
        ids, ends = table.expand(np.arange(len(some))[::-1], [str(w) for w in some])
        assert ids.tolist() == [w for w in some[::-1] for _ in range(w % 3)] and len(ends) == len(some)


def test_counts_equal_the_library(spark, texts):
    library = Tokenizer.from_file(WORD)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (resync.CHUNK, 200):
        for r in resync.token_counts(df, WORD, chunk=chunk, overlap=16).collect():
            text = texts[r.doc_id] or ""
            n = len(library.encode(text, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)


def test_spliced_chunks_equal_whole_texts(texts):
    library, splicer = Tokenizer.from_file(WORD), resync.Splicer(WORD)
    widened = 0
    for text in texts[:120]:
        want = library.encode(text or "", add_special_tokens=False).ids
        for chunk, overlap in ((40, 4), (300, 20)):
            got, _, more = splicer.encode(text or "", chunk, overlap)
            assert got == want
            widened += more
    assert widened


def test_shards_equal_the_library(spark, texts):
    library = Tokenizer.from_file(BYTE)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in wavelet.token_shards(spark, df, BYTE, shard_docs=50).collect()}
    start = 0
    for doc_id, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4")))
        start += len(ids)


def test_shards_of_odd_tables(spark, odd, none):
    assert wavelet.token_shards(spark, odd, BYTE).count() == odd.count()
    assert wavelet.token_shards(spark, none, BYTE).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (3, None), (None, "b b")], "doc_id long, text string")
    got = sorted(wavelet.token_shards(spark, nulls, BYTE).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (None, 2, 3), (3, 5, 1)]


def test_matrix_access_rank_select():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_257, 4000)
    ids[::7] = 11
    built = wavelet.WaveletMatrix.build(ids, 16)
    m = wavelet.WaveletMatrix.from_bytes(memoryview(built.to_bytes()), len(ids), 16)
    assert (m.ids() == ids).all()
    assert all(m.access(i) == ids[i] for i in range(0, len(ids), 61))
    at = np.flatnonzero(ids == 11)
    assert m.count(11) == len(at) and m.select(11, len(at)) == -1
    assert [m.select(11, k) for k in range(0, len(at), 40)] == at[::40].tolist()
    assert all(m.rank(11, i) == (ids[:i] == 11).sum() for i in range(0, len(ids) + 1, 250))
