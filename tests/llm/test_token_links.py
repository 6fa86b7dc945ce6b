import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from brute import ODD_TEXTS
from tillwatch.llm import token_links as tl

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = ODD_TEXTS + ["", "▁x", "a▁b", "<|endoftext|> x<|endoftext|>", "<s> a </s> <unk>", " lead", "x\n", "\n\ny", "漢字かな😀", "a\x00b", "a  b   c",
                    "don't 's", "\x01x", "tab\tx", "é x̀", "aaaaaaaaaaaaaaaaaaaaaaaaa", "1234567890"]


def shown_bytes():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def plain(rows):
    """The contract, document by document and token by token."""
    a, b, byte_of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), shown_bytes()
    a.encode_special_tokens = True

    def pieces(ids):
        for i in ids:
            p = b.id_to_piece(i)
            yield bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        ia = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ib = b.encode(text) if text else []
        ba, bb = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ia], list(pieces(ib))
        if b"".join(ba) != b" " + text.encode() or b"".join(bb) != b" " + text.encode():
            ia, ib, ba, bb = [], [], [], []
        ea, eb = np.cumsum([len(x) for x in ba]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        borders = sorted(set(ea) & set(eb))
        parts, links, low = [], [], 0
        for border in borders:
            pa_ = [i for i, e in zip(ia, ea) if low < e <= border]
            pb_ = [i for i, e in zip(ib, eb) if low < e <= border]
            parts.append(",".join(map(str, pa_)) + "|" + ",".join(map(str, pb_)))
            low = border
        links = [(x, y) for x, e in zip(ia, ea) for y, f in zip(ib, eb) if e == f]
        counts.update(links)
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest() if ia else ""
        found.append((doc_id, len(ia), len(ib), len(parts), links, digest))
    most = defaultdict(int)
    for (x, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        (d, na, nb, ng, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), h)
        for d, na, nb, ng, ls, h in found
    )


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [tl.BLOCK_BYTES, 3000])
def test_equals_the_contract(spark, rows, size):
    data = [(i, t) for i, t in enumerate(HARD + [t for _, t in rows[:60]])]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert got(tl.aligned(df, A, B, size=size)) == plain(data)


def test_odd_tables(spark, odd, none):
    assert got(tl.aligned(odd, A, B)) == plain([(r.doc_id, r.text) for r in odd.collect()])
    assert tl.aligned(none, A, B).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    rows = tl.aligned(nulls, A, B).collect()
    assert sorted((r.doc_id is None, r.n_a, r.n_links) for r in rows) == [(False, 0, 0), (True, 2, 2), (True, 2, 2)]


def test_long_text(spark):
    text = "Sehr lange Rede, kurzer Sinn. " * 160_000 + "é" * 70_000
    assert got(tl.aligned(spark.createDataFrame([(7, text)], "doc_id long, text string"), A, B))[0][:2] == (
        7, len(Tokenizer.from_file(A).encode(" " + text, add_special_tokens=False).ids))


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)

    def random(height, width):
        dense = rng.integers(0, 3, (height, width)) * (rng.random((height, width)) < 0.3)
        rows, columns = np.nonzero(dense)
        begins = np.searchsorted(rows, np.arange(height + 1))
        return dense, tl.Csr(begins, columns, dense[rows, columns], width)

    for most in (1, 7, 10_000):
        (x, a), (y, b) = random(9, 14), random(14, 6)
        out = np.zeros((9, 6), np.int64)
        for i, j, v in tl.row_products(a, b, most):
            assert not out[i, j].any()
            out[i, j] = v
        assert (out == x @ y).all()
        assert (tl.transposed(a).begins == np.searchsorted(np.sort(a.columns), np.arange(15))).all()


def test_links_of_both_kinds(spark):
    docs = spark.createDataFrame([(1, "unbelievable things"), (2, "x")], "doc_id long, text string")
    sides = tl.Sides.of(A, B)
    cut = sides.cut(pa.array(["unbelievable things"]))
    spans = [np.stack([np.concatenate([[0], e[:-1]]), e]).T.tolist() for e in cut.ends]
    want = {(i, j): min(y, v) - max(x, u) for i, (x, y) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if min(y, v) > max(x, u)}
    mine = {(r.a_at, r.b_at): r.shared for r in tl.token_links(docs, A, B).where("doc_id = 1").collect()}
    assert mine == want
    groups = {(r.a_at, r.b_at) for r in tl.token_links(docs, A, B, kind="group").where("doc_id = 1").collect()}
    assert groups == {(i, j) for i, g in enumerate(cut.groups[0]) for j, h in enumerate(cut.groups[1]) if g == h}
