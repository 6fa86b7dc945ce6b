import re
import zlib
from collections import Counter

import pytest

from tillwatch.llm import spelling
from tillwatch.session import HandOffs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, every=spelling.EVERY):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows, every=spelling.EVERY, times=5):
    words = {w: n for w, n in counted(rows, every).items() if len(w) >= 6 and n >= times}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [spelling.BLOCK, 3])
def test_equals_the_contract(spark, block):
    words = ["abcdef", "abcdeg", "abcdefg", "aabcdef", "abccdef", "bcdefgh", "abcdeff", "zbcdef", "ÀBCDEF", "àbcdef", "aaaaaa", "aaaaaaa", "aaaaaaaa",
             "abxdef", "abcde", "straße", "strasse", "mañana", "manana", "niñoso", "ninoso", "abc×ef", "abc÷ef"]
    data = [(i, " ".join([w] * (5 if k % 3 else 30 + k)) + "! " + words[(i + k) % len(words)]) for i in range(8) for k, w in enumerate(words)]
    data += [(None, "Abcdef abcdefĀabcdef"), (3, None), (4, ""), (5, "x" * 20)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    assert got(spelling.spelling_forms(df, block=block)) == plain(data)


def test_equals_the_contract_on_documents(spark, documents, rows):
    few = sorted(rows)[:70]
    df = documents.where(documents.doc_id.isin([d for d, _ in few]))
    for every in (spelling.EVERY, 3):
        assert got(spelling.spelling_forms(df, every=every, times=3)) == plain(few, every, 3)


def test_odd_tables(spark, odd, none):
    assert got(spelling.spelling_forms(odd, times=1)) == plain([(r.doc_id, r.text) for r in odd.collect()], times=1)
    assert spelling.spelling_forms(none).count() == 0


def test_long_texts_and_words(spark):
    long_word = "ab" * 30_000
    text = " ".join([long_word] * 6 + [long_word[:-1] + "c"] * 40 + [long_word[1:]] * 6) + " wordword" * 700_000
    with HandOffs() as held:
        found = {r.word: r for r in spelling.spelling_forms(spark.createDataFrame([(0, text)], "doc_id long, text string"), held=held).collect()}
    assert {len(w): r.n_near for w, r in found.items() if len(w) > 100 and w.startswith("ab") and w.endswith("b")} == {60_000: 2}
    assert found[long_word].form == long_word[:-1] + "c"
    assert found["wordword"].n == 700_000


def test_acceptor_is_minimal():
    acceptor = spelling.Acceptor()
    p = acceptor.initial(sorted(["walking", "talking", "walkers", "talkers"]))
    assert len(acceptor.arcs) == 10  # by letters left: 7 to 3 one state each, two with 2, two with 1, the empty one
    assert sorted(acceptor.common(p, p)) == ["talkers", "talking", "walkers", "walking"]
    assert sorted(acceptor.replaced(p, p)) == [("talkers", "walkers"), ("talking", "walking")]
    q = acceptor.initial(sorted(["walkking", "stalking"]))
    assert sorted(acceptor.inserted(p, q)) == [("talking", "stalking"), ("walking", "walkking")]


def test_hot_half_is_cut_into_squares(spark):
    """Words with one common beginning: no acceptor gets more than two blocks."""
    letters = "abcdefghij"
    words = [("common" + a + b + c + d, 9) for a in letters for b in letters for c in letters for d in letters[:3]]
    df = spark.createDataFrame(words, "word string, n long")
    near = spelling.near_words(df, block=100)
    assert near.count() == sum(9 + 9 + 9 + 2 for _ in words)
    assert near.groupBy("word", "near").count().where("count > 1").count() == 0


def test_roots_follow_long_chains(spark):
    n = 20
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(n)], "word string, form string")
    with HandOffs() as held:
        assert {r.root for r in spelling.roots(forms, held).collect()} == {f"w{n:02}"}
