"""Language of web pages by Bayesian fusion of text, declared markup language, address suffix and host.

* Text: hashed byte trigrams of lower-cased words, one multinomial per language, counted over all documents with a
  language. A page's log-likelihood is the mean per trigram times the root of their number, as trigrams of a text are
  far from independent.
* Markup: the primary tag of ``<html lang>``. How often each declared tag goes with each language is counted over all
  pages, softly, by what their texts say.
* Address: the host's prior is smoothed towards its domain's, that towards its suffix's, that towards all pages', each
  by ``KAPPA`` pages' worth; a page's own text is taken out of its host's counts, so no page speaks twice.

All counts of pages are grouped sums, made map-side first; a host of any size is one row when it is joined back, and the
side of the pages is rows of fixed size that Spark may split where a host is hot.

Every language that a document has is a candidate, however many there are. Evidence and sums are arrays with one entry
for each language. Counts stay a Spark table; the driver sees the names of the languages and the counts of ``BLOCK`` of
them at a time, and pages are read against one such block after another. Up to ``BLOCK`` languages that is one pass over
the pages; beyond, the passes go over the pages' trigram counts.

Defined results: a page without visible words has equal likelihoods and is decided by the rest; a null url has empty
host, domain and suffix, a null html no text and no declared tag; without any document of known language there is no
language to choose and ``lang`` is null; repeated pages are pages of their own; ties go to the first language by name;
empty tables give no rows; other columns are ignored; a page of any length is read whole.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwatch.llm.texts import map_batches, steps, strings
from tillwatch.session import HandOffs, hand_off

BUCKETS = 1 << 14
#: bytes of text or markup that are turned into trigrams at once
STEP = 1 << 20
KAPPA = 8.0
#: languages whose counts are held at once
BLOCK = 256
#: what isn't prose of the page
DROPPED = re.compile(r"(?is)<(script|style|nav|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")
ADDRESS = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def trigram_buckets(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams that hold a letter (ASCII or beyond), and the text of each; digits and marks are blanks."""
    raw = " ".join(f"\n{t}" for t in texts.to_pylist()).lower().encode()
    b = np.frombuffer(raw, np.uint8).astype(np.int64)
    text = np.cumsum(b == 10) - 1 if len(b) else b
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    b = np.where(letter, b, 32)
    if len(b) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    gram = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    keep = (letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:] >= 2) & (text[:-2] == text[2:])
    return (gram[keep] * 0x9E3779B1 >> 11) % BUCKETS, text[:-2][keep]


def _one_line(texts: pa.Array) -> pa.StringArray:
    """Line feeds separate texts while trigrams are counted."""
    import pyarrow.compute as pc

    return pc.replace_substring(strings(texts), "\n", " ")


def trigram_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], DataFrame]:
    """Languages by name, and the table l (place of the language in the list), b (bucket), n over all their documents."""
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    langs = sorted(r.lang for r in known.select("lang").distinct().collect())
    place = {x: i for i, x in enumerate(langs)}

    def count(batches):
        rows: dict[int, int] = {}
        totals = np.zeros((BLOCK, BUCKETS), np.int64)

        def found():
            for x, row in rows.items():
                b = np.flatnonzero(totals[row])
                yield pa.RecordBatch.from_pydict({"l": np.full(len(b), x, np.int32), "b": b.astype(np.int32), "n": totals[row, b]})

        for batch in steps(batches, limit=STEP):
            bucket, text = trigram_buckets(_one_line(batch.column("text")))
            coded = batch.column("lang").dictionary_encode()
            of = coded.indices.to_numpy()[text]
            here = [place[x] for x in coded.dictionary.to_pylist()]
            for first in range(0, len(here), BLOCK):
                part = here[first : first + BLOCK]
                if len(rows.keys() | set(part)) > BLOCK:  # partial counts go out, to be summed with the others
                    yield from found()
                    rows.clear()
                    totals[:] = 0
                for x in part:
                    rows.setdefault(x, len(rows))
                row = np.full(len(here), -1)
                row[first : first + len(part)] = [rows[x] for x in part]
                row = row[of]
                mine = row >= 0
                more = np.bincount(row[mine] * BUCKETS + bucket[mine], minlength=len(rows) * BUCKETS)
                totals[: len(rows)] += more.reshape(-1, BUCKETS)
        yield from found()

    counts = map_batches(known, count, "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    return langs, hand_off(counts, "trigram-counts")


def trigram_model(counts: DataFrame, first: int, size: int) -> np.ndarray:
    """Log-probabilities by bucket (rows) of ``size`` languages (columns) from the place ``first``."""
    block = counts.where(F.col("l").between(first, first + size - 1)).toArrow()
    l, b, n = (block.column(c).to_numpy() for c in ("l", "b", "n"))
    smooth = np.full((BUCKETS, size), 0.5)
    smooth[b, l - first] += n
    return np.log(smooth) - np.log(smooth.sum(0))


def _likelihoods(bucket: np.ndarray, n: np.ndarray, cut: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log-likelihood of each page (rows) in each language; buckets and their counts lie between neighbouring cuts."""
    out = np.zeros((len(cut) - 1, logs.shape[1]))
    for i, (a, b) in enumerate(zip(cut, cut[1:])):
        if b > a:
            # added row by row, so equal languages have equal sums
            out[i] = np.add.reduce(logs[bucket[a:b]] * n[a:b, None], 0) / np.sqrt(n[a:b].sum())
    return out


def _posterior(logs: np.ndarray) -> np.ndarray:
    """Normalised probabilities of the log weights in each row."""
    weights = np.exp(logs - logs.max(1, keepdims=True))
    return weights / weights.sum(1, keepdims=True)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def _dense(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def evidence(pages: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """page_id, host, domain, suffix, declared, t and q of each page, written out.

    ``t`` has the log-likelihood of the text in each of the ``k`` languages, ``q`` the probabilities by it alone.
    """
    names = ["page_id", "host", "domain", "suffix", "declared"]
    kinds = "page_id long, host string, domain string, suffix string, declared string, t array<double>"

    def read(logs, last):
        def run(batches):
            for batch in steps(batches, "html", STEP):
                raw = batch.column("html").to_pylist()
                shown = pa.array([entities.unescape(DROPPED.sub(" ", h or "")) for h in raw], pa.string())
                bucket, text = trigram_buckets(_one_line(shown))
                key, n = np.unique(text * BUCKETS + bucket, return_counts=True)
                cut = np.searchsorted(key, np.arange(len(raw) + 1) * BUCKETS)
                key %= BUCKETS
                hosts = [m.group(1).lower().rstrip(".") if (m := ADDRESS.match(u or "")) else "" for u in batch.column("url").to_pylist()]
                declared = [m.group(1).lower() if (m := DECLARED.search(h or "")) else "" for h in raw]
                domains = [".".join(h.split(".")[-2:]) for h in hosts]
                columns = [batch.column("page_id"), pa.array(hosts), pa.array(domains), pa.array([d.rpartition(".")[2] for d in domains]), pa.array(declared)]
                yield written(columns, _likelihoods(key, n, cut, logs), cut, key, n, last)

        return run

    def extend(logs, last):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    cut = batch.column("b").offsets.to_numpy()
                    bucket, n = (batch.column(c).flatten().to_numpy() for c in "bn")
                    cut = cut - cut[0]
                    t = np.concatenate([_dense(batch.column("t")), _likelihoods(bucket, n, cut, logs)], 1)
                    yield written([batch.column(c) for c in names], t, cut, bucket, n, last)

        return run

    def written(columns, t, cut, bucket, n, last):
        if last:
            return pa.RecordBatch.from_arrays([*columns, _lists(t), _lists(_posterior(t))], [*names, "t", "q"])
        of = pa.array(cut, pa.int32())
        grams = [pa.ListArray.from_arrays(of, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(of, pa.array(n, pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, _lists(t), *grams], [*names, "t", "b", "n"])

    table, before = pages.select("page_id", "url", "html"), HandOffs()
    for first in range(0, k, BLOCK):
        logs, last, owner = trigram_model(counts, first, min(BLOCK, k - first)), first + BLOCK >= k, HandOffs()
        scored = map_batches(table, (extend if first else read)(logs, last), kinds + (", q array<double>" if last else ", b array<int>, n array<long>"))
        table = owner.write(scored, "page-evidence")
        before.close()
        before = owner
    return table


def _summed(df: DataFrame, by: list[str], values: Column | str, name: str) -> DataFrame:
    """Sums of arrays of one length, entry by entry, for each group."""
    entries = df.select(*by, F.posexplode(values).alias("j", "v")).groupBy(*by, "j").agg(F.sum("v").alias("v"))
    whole = F.array_sort(F.collect_list(F.struct("j", "v")))  # one of each entry is left
    return entries.groupBy(*by).agg(F.transform(whole, lambda x: x["v"]).alias(name))


def page_languages(pages: DataFrame, docs: DataFrame, kappa: float = KAPPA) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host, suffix of each page."""
    langs, counts = trigram_counts(docs)
    k = len(langs)
    if not k:
        empty = F.lit(None).cast("string")
        return pages.select("page_id", empty.alias("lang"), F.lit(None).cast("double").alias("confidence"), empty.alias("text_lang"), empty.alias("declared"), empty.alias("host"), empty.alias("suffix"))
    table = evidence(pages, counts, k)
    # the first entry counts pages, the others are those of the languages
    hosts = hand_off(_summed(table, ["host", "domain", "suffix"], F.concat(F.array(F.lit(1.0)), "q"), "h"), "host-sums")
    domains, suffixes = _summed(hosts, ["domain"], "h", "d"), _summed(hosts, ["suffix"], "h", "s")
    whole = _summed(hosts, [], "h", "g").collect()[0].g or [0.0] * (k + 1)
    base = F.lit([(x + 1.0) / (whole[0] + k) for x in whole[1:]])
    # each level leans on the one above; none is a copy of it, as the counts of one page weigh little in theirs
    smoothed = lambda tag, above: F.zip_with(F.slice(tag, 2, k), above, lambda x, a: (x + kappa * a) / (F.col(tag)[0] + kappa))
    of_host = hosts.join(domains, "domain").join(suffixes, "suffix").withColumn("p", smoothed("s", base))
    of_host = of_host.withColumn("p", smoothed("d", F.col("p"))).select("host", "h", "p")
    tags = hand_off(_summed(table, ["declared"], "q", "m"), "tag-sums")
    kinds = float(tags.count() or 1)
    word = _summed(tags, [], "m", "w").collect()[0].w or [0.0] * k
    of_tag = tags.select("declared", F.zip_with("m", F.lit([w + 0.5 * kinds for w in word]), lambda m, w: F.log((m + 0.5) / w)).alias("m"))
    full = table.join(of_host, "host").join(of_tag, "declared")

    def fuse(batches):
        names = pa.array(langs, pa.string())
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                t, q, h, p, m = (_dense(batch.column(c)) for c in "tqhpm")
                prior = np.maximum(1e-12, (np.maximum(0.0, h[:, 1:] - q) + kappa * p) / (h[:, :1] - 1 + kappa))
                fused = _posterior(t + m + np.log(prior))
                found = {"page_id": batch.column("page_id"), "lang": names.take(pa.array(fused.argmax(1))), "confidence": fused.max(1)}
                found["text_lang"] = names.take(pa.array(t.argmax(1)))
                yield pa.RecordBatch.from_pydict(found | {c: batch.column(c) for c in ("declared", "host", "suffix")})

    full = full.select("page_id", "declared", "host", "suffix", *"tqhpm")
    return map_batches(full, fuse, "page_id long, lang string, confidence double, text_lang string, declared string, host string, suffix string")
