"""Held-out passages inside training documents, by winnowed fingerprints.

Words are folded (case, accents, punctuation, spacing, line-end hyphens; each
Han character is a word), every ``K`` words in a row are hashed, and of every
``WINDOW`` hashes in a row the least is kept. Two texts that share ``K + WINDOW
- 1`` words in a row share a kept hash. Fingerprints of documents and passages
are joined; each hit is extended both ways by furthest-reaching edit steps over
words, so changed, dropped and added words are followed alike.

Why nothing is lost: let a stretch of at least ``least`` words hold at most
``rate`` changes a word. Cut at some of its changes into parts of m to 2m
changes, m being the least number with m / rate >= least, one part keeps the
rate; it is at least ``least`` words long, has at most 2m changes and a run of
``surest_run`` equal words. So following 2m changes from each hit finds it.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.joins import in_bitmap, key_bitmap
from quire.session import cut_lineage

K, WINDOW = 4, 2
#: Fingerprints of passages are broadcast up to so many (24 MB), and passages' words up to so many (32 MB); beyond, both are joined by shuffle.
BROADCAST_PRINTS, BROADCAST_WORDS = 1_000_000, 4_000_000
#: Cases of a document that one row carries at most on average, whatever the number of cases.
CASES_A_ROW = 10_000
_MARKS = re.compile("[̀-ͯ]+")
_INNER = re.compile("[-‐‑­¬][ \t]*\r?\n[ \t]*|['’ʼ`´­‐‑-]")
_WORDS = re.compile("[㐀-鿿]|[^\\W_㐀-鿿]+")


@lru_cache(maxsize=200_000)
def _plain(word: str) -> tuple[str, ...]:
    return tuple(_WORDS.findall(_MARKS.sub("", unicodedata.normalize("NFKD", word))))


def folded_words(text: str) -> list[str]:
    """The words of a text without case, accents, punctuation and line-end hyphens."""
    t = text.casefold()
    if t.isascii():
        return _WORDS.findall(_INNER.sub("", t))
    words = _WORDS.findall(_INNER.sub("", _MARKS.sub("", t)))
    return [x for w in words for x in ((w,) if w.isascii() else _plain(w))]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in a row, number of the text each stands in)."""
    words = [folded_words(t) for t in texts]
    flat = np.array([w for ws in words for w in ws], dtype=object)
    owner = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
    return (pd.util.hash_array(flat, categorize=True) if len(flat) else np.zeros(0, np.uint64)), owner


def short_words(text: str) -> list[int]:
    """The words of one text as the 32-bit hashes that document_prints keeps."""
    return word_hashes([text])[0].astype(np.uint32).tolist()


def winnowed(ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the kept K-grams, their hashes) of word hashes laid in a row; no gram or window crosses from one text to the next.

    Of each WINDOW grams in a row the least hash is kept, the right-most of
    equals; a text with fewer grams than WINDOW keeps its least one.
    """
    n = len(ids) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(K):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (ids[j : j + n] + (h >> np.uint64(29)))
    inside = owner[:n] == owner[K - 1 :]
    places, own, h = np.flatnonzero(inside), owner[:n][inside], h[inside]
    kept = np.zeros(len(h), bool)
    m = len(h) - WINDOW + 1
    if m > 0:
        w = np.stack([h[WINDOW - 1 - j : WINDOW - 1 - j + m] for j in range(WINDOW)])  # right-most first
        at = np.arange(m) + WINDOW - 1 - np.argmin(w, axis=0)
        kept[at[own[:m] == own[WINDOW - 1 :]]] = True
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(own)])
    for a, k in zip(first[size < WINDOW], size[size < WINDOW]):
        kept[a + k - 1 - int(np.argmin(h[a : a + k][::-1]))] = True
    return places[kept], h[kept]


def most_changes(least: int, rate: float) -> int:
    """Changes to follow from a hit: 2m of the module's docstring."""
    return 2 * next(m for m in range(1, least + 1) if m >= rate * least) if rate > 0 else 0


_near = lru_cache(most_changes)


def surest_run(least: int, rate: float) -> int:
    """Equal words in a row that every part of the module's docstring has at least."""
    return min(math.ceil((max(least, math.ceil(m / rate) if m else 0) - m) / (m + 1)) for m in range(most_changes(least, rate) + 1))


def reach(a: list[int], b: list[int], changes: int) -> list[int]:
    """The most words of ``a`` from its start that ``b`` meets from its start with 0 to ``changes`` changes, ending on an equal word."""
    na, nb, mid = len(a), len(b), changes + 1
    x, n = 0, min(len(a), len(b))
    while x < n and a[x] == b[x]:
        x += 1
    front, out, best = [-2] * (2 * changes + 3), [x], x
    front[mid] = x  # by the words of a ahead of those of b
    for c in range(1, changes + 1):
        wide = front[:]
        for d in range(mid - c, mid + c + 1):
            x, z = front[d], front[d - 1]
            x = (x if x > z else z) + 1  # a word changed, or one of a left out
            z = front[d + 1]
            if z > x:  # one of b left out
                x = z
            if x > na:
                x = na
            y = x - d + mid
            if x < 0 or y < 0 or y > nb:
                continue
            at = x
            while x < na and y < nb and a[x] == b[y]:
                x += 1
                y += 1
            wide[d] = x
            if x > at and x > best:
                best = x
        front = wide
        out.append(best)
    return out


def _best(left: list[int], right: list[int], rate: float) -> tuple[int, int, int]:
    """(length, changes, words to the left) of the longest stretch around a hit within the rate."""
    best = (0, 0, 0)
    for cl, x in enumerate(left):
        for cr, y in enumerate(right):
            if x + y > best[0] and cl + cr <= rate * (x + y):
                best = (x + y, cl + cr, x)
    return best


def stretch(doc: list[int], passage: list[int], hits: list[tuple[int, int]], least: int, rate: float) -> tuple[int, int, int]:
    """(words, changed words, first word in the document) of the longest stretch found from the hits; words 0 without one of ``least``.

    ``hits``: (document place, passage place) of equal grams. Hits inside a
    stretch already found, or inside a run already tried, are not tried again.
    """
    found = (0, 0, 0)
    near = _near(least, rate)
    tried: dict[int, int] = {}
    covered: list[tuple[int, int, int]] = []
    for i, j in sorted(hits):
        d = i - j
        if tried.get(d, -1) >= i or any(a <= i < b and abs(d - e) <= near for a, b, e in covered):
            continue
        # some ``least`` words of the part around this hit have at most ``near`` changes, so that many equal words must be near
        close = set(doc[max(0, i - least - near) : i + least + near])
        if sum(map(close.__contains__, passage[max(0, j - least + K) : j + least])) < least - near:
            continue
        ahead, behind = passage[j:], passage[:j][::-1]
        right = reach(ahead, doc[i : i + len(ahead) + near], near)
        left = reach(behind, doc[max(0, i - j - near) : i][::-1], near)
        tried[d] = i + right[0] - 1
        if _best(left, right, rate)[0] < least:
            continue
        all_ = int(rate * len(passage))
        n, changed, before = _best(reach(behind, doc[max(0, i - j - all_) : i][::-1], all_), reach(ahead, doc[i : i + len(ahead) + all_], all_), rate)
        covered.append((i - before, i - before + n, d))
        if n > found[0]:
            found = (n, changed, max(0, i - before))
    return found


def passage_prints(cases: DataFrame) -> DataFrame:
    """h, case_id, at: kept fingerprints of each passage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, owner = word_hashes(list(pdf["passage"]))
            at, h = winnowed(ids, owner)
            first = np.searchsorted(owner, np.arange(len(pdf)))
            yield pd.DataFrame({"h": h.view(np.int64), "case_id": pdf["case_id"].to_numpy()[owner[at]], "at": (at - first[owner[at]]).astype(np.int32)})

    return cases.mapInPandas(run, "h long, case_id string, at int")


def document_prints(docs: DataFrame, bitmap: bytes) -> DataFrame:
    """doc_id, text_hash, words, places, hs: the kept fingerprints of each document that pass the bitmap of the passages', and its words as 32-bit hashes.

    Documents without such a fingerprint give no row.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, words binary, places array<int>, hs array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")
        for pdf in batches:
            ids, owner = word_hashes(list(pdf["text"]))
            at, h = winnowed(ids, owner)
            some = in_bitmap(bits, h)
            at, h = at[some], h[some].view(np.int64)
            first, mine = np.searchsorted(owner, np.arange(len(pdf) + 1)), np.searchsorted(owner[at], np.arange(len(pdf) + 1))
            short = ids.astype(np.uint32)
            out = [(d, x, short[first[k] : first[k + 1]].tobytes(), (at[mine[k] : mine[k + 1]] - first[k]).astype(np.int32), h[mine[k] : mine[k + 1]]) for k, (d, x) in enumerate(zip(pdf["doc_id"], pdf["text_hash"])) if mine[k + 1] > mine[k]]
            yield pd.DataFrame(out, columns=["doc_id", "text_hash", "words", "places", "hs"])

    return docs.mapInPandas(run, schema)


def leaks(docs: DataFrame, cases: DataFrame, least: int = 20, rate: float = 0.14) -> DataFrame:
    """doc_id, case_id, n_words, n_changed, doc_word of each leaked passage, once per pair.

    ``docs``: doc_id, text; ``cases``: case_id, passage. Null ids, null or short
    passages and null texts leak nothing. Documents are scanned once; of
    those with a possible hit the fingerprints and word hashes are kept, and
    meet again by doc_id. What is broadcast is of fixed or checked size. ``least`` and ``rate`` for which
    WINDOW could miss a stretch are refused.
    """
    if surest_run(least, rate) < K + WINDOW - 1:
        raise ValueError(f"stretches of {least} words with {rate} changes a word may have no {K + WINDOW - 1} equal words in a row")
    spark = docs.sparkSession
    d = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    held = cases.where(F.col("passage").isNotNull() & F.col("case_id").isNotNull()).select(F.col("case_id").cast("string").alias("case_id"), "passage").distinct()
    # several passages under one case_id are kept apart
    held = cut_lineage(held.select(F.concat_ws("\x1f", "case_id", F.md5("passage")).alias("case_id"), "passage"))
    prints = cut_lineage(passage_prints(held))
    size = held.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("passage")).alias("chars")).first()
    small = prints.count() <= BROADCAST_PRINTS
    met = cut_lineage(document_prints(d, key_bitmap(prints, "h")))
    each = met.select("doc_id", "text_hash", F.explode(F.arrays_zip(F.col("places").alias("place"), F.col("hs").alias("h"))).alias("x")).select("doc_id", "text_hash", "x.place", "x.h")
    hits = each.join(F.broadcast(prints) if small else prints, "h")
    pairs = hits.groupBy("doc_id", "text_hash", "case_id").agg(F.collect_set(F.shiftleft(F.col("place").cast("long"), 32) + F.col("at")).alias("hits"))
    shared = None
    if (size["chars"] or 0) <= 2 * BROADCAST_WORDS:  # a word has two chars or more with its blank, a Han character one
        shared = spark.sparkContext.broadcast({r["case_id"]: short_words(r["passage"]) for r in held.collect()})
        pairs = pairs.withColumn("passage", F.lit(None).cast("string"))
    else:
        pairs = pairs.join(held, "case_id")
    group = F.pmod(F.xxhash64("case_id"), F.lit(max(1, -(-size["n"] // CASES_A_ROW)))).alias("part")
    per_doc = pairs.groupBy("doc_id", "text_hash", group).agg(F.collect_list(F.struct("case_id", "passage", "hits")).alias("found"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, case_id string, n_words int, n_changed int, doc_word int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, words, ids, texts, places in zip(*(pdf[c] for c in ("doc_id", "words", "case_id", "passage", "hits"))):
                doc = np.frombuffer(words, np.uint32).tolist()
                for case, text, at in zip(ids, texts, places):
                    passage = shared.value[case] if shared is not None else short_words(text)
                    n, changed, start = stretch(doc, passage, [(x >> 32, x & 0xFFFFFFFF) for x in np.asarray(at).tolist()], least, rate)
                    if n:
                        out.append((doc_id, case.split("\x1f")[0], n, changed, start))
            yield pd.DataFrame(out, columns=["doc_id", "case_id", "n_words", "n_changed", "doc_word"])

    found = met.select("doc_id", "text_hash", "words").dropDuplicates(["doc_id", "text_hash"]).join(per_doc, ["doc_id", "text_hash"]).select("doc_id", "words", *[F.col(f"found.{c}").alias(c) for c in ("case_id", "passage", "hits")]).mapInPandas(run, schema)
    return found.groupBy("doc_id", "case_id").agg(F.max(F.struct("n_words", F.negative("n_changed").alias("c"), "doc_word")).alias("b")).select("doc_id", "case_id", "b.n_words", F.negative("b.c").alias("n_changed"), "b.doc_word")


def leak_report(docs: DataFrame, cases: DataFrame, least: int = 20, rate: float = 0.14) -> DataFrame:
    """case_id, n_docs, longest: how far each held-out case leaked; cases without a leak have 0."""
    found = leaks(docs, cases, least, rate).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_words").alias("w"))
    return cases.select("case_id").dropDuplicates().join(found, "case_id", "left").select("case_id", F.coalesce("n", F.lit(0)).alias("n_docs"), F.coalesce("w", F.lit(0)).alias("longest"))
