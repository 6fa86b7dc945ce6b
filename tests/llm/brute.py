"""Plain versions of the operators' definitions, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [
    None, "", " ", "a", "A  b\tc\n", "a b c d e", "a b c d e f", "A B C D E f", "x " * 60, "\n\nline one\nline one\n",
    "one two three one two three one two three", "é ü ß ñ " * 20, "word word", "#a *b $c %d & | <e>", "日本語 テキスト",
]


def lower_ascii(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def exact_groups(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACE.sub("", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for doc_id, text in rows:
        plain = SPACE.sub("", text or "")
        keep = min(groups[plain])[3]
        out.append((doc_id, keep, len(groups[plain]), doc_id == keep, hashlib.sha256(plain.encode()).hexdigest()))
    return out


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(hit), failed


def shingles(text):
    words = WORD.findall(lower_ascii(text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(5))))


def near_components(rows, percent):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    shared = Counter()
    for ds in by.values():
        ds.sort()
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return [(d, len(s), root(d), root(d) == d) for d, s in sets.items()]
