"""Noise in text from scanned pages: what is damaged, and the text repaired.

Words: a lexicon with corpus frequencies comes from pages that were not
scanned. A word that scanned pages hold and others do not is a suspect; a
symmetric-delete index over confusable units finds the lexicon words one
confusion away, a weighted edit distance judges them, and bigrams choose among
several. Lines: a running header repeats over the pages of its PDF, compared in
a form in which confusable characters are alike; a printed page number equals
the number of its page or is a roman numeral on a line of its own.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.joins import in_bitmap, key_bitmap, salted_lookup
from quire.session import cut_lineage

#: What a scan reads -> what stood there.
CONFUSIONS = {
    "0": ("o", "о"), "1": ("l", "i", "і"), "|": ("l", "i", "і"), "!": ("l", "i"), "5": ("s",), "6": ("b", "б"), "8": ("b", "в"), "9": ("g",), "@": ("a", "а"), "3": ("з",), "4": ("ч",), "$": ("s",), "€": ("e",), "2": ("z",),
    "c": ("e",), "e": ("c",), "b": ("h",), "h": ("b",), "f": ("t",), "t": ("f",), "l": ("i", "t"), "i": ("l",), "í": ("i",),
    "rn": ("m",), "m": ("rn", "in"), "ri": ("n",), "n": ("ri",), "ii": ("u", "n"), "u": ("ii",), "cl": ("d",), "d": ("cl",), "in": ("m",), "vv": ("w",), "w": ("vv",), "iii": ("ш", "m"), "nn": ("m",), "li": ("h",),
}
#: Cost of one confusion, and of one digit or sign read for a letter; any other edit costs 1.
CONFUSED, SIGNED = 0.3, 0.1
_TRUE_UNITS = sorted({t for ts in CONFUSIONS.values() for t in ts}, key=len)
_SEEN_UNITS = sorted(CONFUSIONS, key=len)
_SIGN = set("0123456789|!@$€")
#: What counts as a word: up to so many chars. Longer runs are addresses, codes or encoded data, which no lexicon has.
WORD_CHARS = 64
_SALTS = 8
_COUNT_BATCH = 300_000
HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐­¬–][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_TOKEN = re.compile(r"[^\s,;:.()\[\]\"“”„«»…'’‘?=/+{}<>\\^~#_*%&§°•☐☑–—‐­¬-]+")
_ONLY_BARS = re.compile(r"[lit1|!]+")


def tokens(text: str) -> list[str]:
    """Lower-case words, with the digits and signs that a scan puts for letters, line-end hyphens removed."""
    if "\n" in text:
        text = HYPHEN.sub("", text)
    return _TOKEN.findall(text.lower())


def word_counts(blocks: DataFrame) -> DataFrame:
    """w, n_scan, n_native: occurrences on scanned and on other pages by extraction_method, summed per task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def out() -> pd.DataFrame:
            both = seen[0].keys() | seen[1].keys()
            keep = [w for w in both if len(w) <= WORD_CHARS]
            df = pd.DataFrame({"w": keep, "s": [seen[0][w] for w in keep], "n": [seen[1][w] for w in keep]})
            seen[0].clear(), seen[1].clear()
            return df

        for pdf in batches:
            for scan, text in zip(pdf["scan"], pdf["text"]):
                seen[0 if scan else 1].update(tokens(text))
            if len(seen[0]) + len(seen[1]) > _COUNT_BATCH:
                yield out()
        yield out()

    b = blocks.where(F.col("text").isNotNull() & F.col("extraction_method").isin("ocr", "mixed", "native")).select((F.col("extraction_method") != "native").alias("scan"), "text")
    c = b.mapInPandas(count, "w string, s long, n long")
    return c.groupBy("w").agg(F.sum("s").alias("n_scan"), F.sum("n").alias("n_native")).where(F.col("w").rlike(r"\p{L}.*\p{L}|^\p{L}[0-9|!@$€]$|^[0-9|!@$€]\p{L}$"))


def deletes(word: str, units: list[str]) -> list[str]:
    """The word with one confusable unit taken out, its place marked."""
    out = []
    for u in units:
        at = word.find(u)
        while at >= 0:
            out.append(f"{word[:at]}\x01{word[at + len(u):]}")
            at = word.find(u, at + 1)
    return out


def _classes() -> dict[str, str]:
    """Each sign, and each letter that a sign may stand for, with the first of all that hang together."""
    of: dict[str, str] = {}
    for sign in sorted(_SIGN & CONFUSIONS.keys()):
        group = {sign, *CONFUSIONS[sign]}
        heads = {of[x] for x in group if x in of}
        head = min(heads | {sign})
        of = {k: head if v in heads else v for k, v in of.items()} | dict.fromkeys(group, head)
    return of


_COLLAPSE = str.maketrans(_classes())


def collapsed(word: str) -> str:
    """A word with signs and the letters they may stand for made equal, so that a word and all its readings meet on one key."""
    return word.translate(_COLLAPSE)


def reads_as(word: str, true: str) -> bool:
    """Whether ``true`` is ``word`` with each digit and sign, and nothing else, put back to a letter."""
    return len(word) == len(true) and all(t in CONFUSIONS.get(c, ()) if c in _SIGN else c == t for c, t in zip(word, true))


@lru_cache(maxsize=200_000)
def weighted_distance(seen: str, true: str) -> float:
    """Edit distance in which a sign for a letter costs SIGNED, another listed confusion CONFUSED and any other edit 1."""
    n, m = len(seen), len(true)
    d = [[math.inf] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            c = d[i][j]
            if c == math.inf:
                continue
            if i < n and j < m:
                d[i + 1][j + 1] = min(d[i + 1][j + 1], c + (seen[i] != true[j]))
            if i < n:
                d[i + 1][j] = min(d[i + 1][j], c + 1)
            if j < m:
                d[i][j + 1] = min(d[i][j + 1], c + 1)
            for k in (1, 2, 3):
                for t in CONFUSIONS.get(seen[i : i + k], ()) if i + k <= n else ():
                    if true.startswith(t, j):
                        d[i + k][j + len(t)] = min(d[i + k][j + len(t)], c + (SIGNED if seen[i : i + k] in _SIGN else CONFUSED))
    return d[n][m]


def misreadings(counts: DataFrame, most: float = 0.65, ratio: int = 10) -> DataFrame:
    """w, c, distance, n_true: words of scanned pages with the lexicon words they may stand for.

    A suspect is at least five times as frequent on scanned pages as on others,
    and two letters alone, near to any other two, are none.
    A candidate of a word with digits or signs is one that these may stand for;
    of other words, and of words of two chars, one that is ``ratio`` times as
    frequent. Other words' candidates are at most ``most`` away. Both sides meet
    on their deletes, or on their collapsed forms, only.
    """
    lex = counts.where((F.col("n_native") >= 1) & (F.col("n_native") * 5 > F.col("n_scan")) & ~F.col("w").rlike(r"[0-9|!@$€]")).select("w", "n_native")
    sus = counts.where((F.col("n_native") * 5 <= F.col("n_scan")) & ~F.col("w").rlike(r"^[lit1|!]+$") & ((F.length("w") > 2) | F.col("w").rlike(r"[0-9|!@$€]"))).select("w", "n_scan")

    def lex_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(k, w, n) for w, n in zip(pdf["w"], pdf["n_native"]) for k in ["\x02" + collapsed(w), *deletes(w, _TRUE_UNITS)]]
            yield pd.DataFrame(out, columns=["k", "c", "n_true"])

    def sus_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w, n in zip(pdf["w"], pdf["n_scan"]):
                if _SIGN & set(w):
                    out.append(("\x02" + collapsed(w.strip("!") or w), w, n, True))
                else:
                    out += [(k, w, n, False) for k in deletes(w, _SEEN_UNITS)]
            yield pd.DataFrame(out, columns=["k", "w", "n_seen", "signed"])

    pairs = sus.mapInPandas(sus_keys, "k string, w string, n_seen long, signed boolean").join(lex.mapInPandas(lex_keys, "k string, c string, n_true long"), "k")
    pairs = pairs.where((F.col("signed") & (F.length("w") > 2)) | (F.col("n_true") >= ratio * F.col("n_seen")))
    pairs = pairs.groupBy("w", "c", "signed").agg(F.max("n_true").alias("n_true"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bare = [w.strip("!") or w if s else w for w, s in zip(pdf["w"], pdf["signed"])]
            far = [weighted_distance(w, c) if not s or reads_as(w, c) else math.inf for w, c, s in zip(bare, pdf["c"], pdf["signed"])]
            near = [f < math.inf if s else f <= most for f, s in zip(far, pdf["signed"])]
            yield pdf.assign(distance=far)[near][["w", "c", "distance", "n_true"]]

    return pairs.mapInPandas(judge, "w string, c string, distance double, n_true long")


# --- lines ---------------------------------------------------------------------

_ROMAN = r"(?:x{0,3}(?:ix|iv|v?i{0,3}))"
_NUMBER = rf"(?:[\[(]\s*\d{{1,5}}\s*[\])]|[-–—]\s*\d{{1,5}}\s*[-–—]|(?:p|pg|page|seite|página|pág|str|стор|s)?\.?\s*\d{{1,5}}(?:\s*(?:/|of|de|von|z|sur|з)\s*\d{{1,5}})?|{_ROMAN})"
_ALONE = re.compile(rf"\s*({_NUMBER})\s*", re.I)
_BEFORE = re.compile(rf"\s*({_NUMBER})(?:\s{{2,}}|\s*[|·]\s*)(\S.*)", re.I)
_AFTER = re.compile(rf"\s*(\S.*?)(?:\s{{2,}}|\s*[|·]\s*)({_NUMBER})\s*", re.I)
_DIGITS = re.compile(r"\d+")
_NO_HEADER = re.compile(r"_{2}|\.{4}|\t|(?: \.){3}|\[[ xX]?\]|\s=\s|\S\s{2,}\S+\s{2,}\S|\|.*\||[;{}<>]|[.?,]$|^\s*(?:[-*•☐☑]|\(?\w{1,2}[.)])\s")
#: A capital I read as l.
_MISREAD_CAPITAL = re.compile("l[bcdfghjkmnpqrstvwxz]")
#: Applied after the single characters, so written in what those become.
_ALIKE = (("vv", "w"), ("cl", "d"), ("rn", "m"), ("rl", "n"), ("ln", "m"), ("lll", "ш"), ("ll", "u"), ("nn", "m"))
_ALIKE_CHARS = str.maketrans({"0": "o", "о": "o", "1": "l", "|": "l", "!": "l", "i": "l", "і": "l", "t": "f", "5": "s", "6": "b", "8": "b", "9": "g", "@": "a", "а": "a", "$": "s", "e": "c", "е": "c", "с": "c", "h": "b", "3": "з", "4": "ч"})


def alike(line: str) -> str:
    """A line reduced so that what a scan confuses becomes equal: case, accents, blanks, confusable characters."""
    t = "".join(c for c in unicodedata.normalize("NFKD", line.lower()) if not unicodedata.combining(c) and (c.isalnum() or c in "|!@$"))
    t = t.translate(_ALIKE_CHARS)
    for a, b in _ALIKE:
        t = t.replace(a, b)
    return t


def roman(s: str) -> int:
    v = {"i": 1, "v": 5, "x": 10}
    return sum(-v[a] if b in v and v[b] > v[a] else v[a] for a, b in zip(s, [*s[1:], " "]))


def number_in(part: str, page: int | None) -> bool:
    """Whether a matched number is the printed number of a page (0-based ``page``)."""
    d = _DIGITS.findall(part)
    if d:
        return page is not None and int(d[0]) == page + 1
    return bool(part.strip())


def line_evidence(text: str, page: int | None) -> list[tuple[str, str, str]]:
    """(kind, key, line) of a block's lines: page numbers, and possible headers with their reduced form."""
    out = []
    for line in text.split("\n"):
        bare = line.strip()
        if not bare or (len(bare) > 110 and len(bare.split()) > 18):  # more words than a header and its number have
            continue
        if len(bare) <= 24 and (m := _ALONE.fullmatch(line)):
            if number_in(m[1], page):
                out.append(("page_number", "", line))
            continue
        rest, numbered = bare, False
        if "  " in bare or "|" in bare or "·" in bare:
            if (m := _BEFORE.fullmatch(line)) and number_in(m[1], page):
                rest, numbered = m[2], True
            elif (m := _AFTER.fullmatch(line)) and number_in(m[2], page):
                rest, numbered = m[1], True
        # a header opens like a title and is short; running text seldom does both
        if not numbered and (rest[-1] in ".?," or (rest[0].islower() and not _MISREAD_CAPITAL.match(rest))):
            continue
        if not 2 <= rest.count(" ") + 1 <= (14 if numbered else 9) or _NO_HEADER.search(rest):
            continue
        if sum(map(str.isalpha, rest)) < 6:
            continue
        if numbered:
            out.append(("page_number", "", line))
        key = alike(rest)
        if len(key) >= 6:
            out.append(("numbered" if numbered else "line", key, line))
    return out


_EVIDENCE = "block_id string, doc_id string, page_num int, ocr boolean, heading boolean, apart boolean, kind string, key string, line string"


def evidence(blocks: DataFrame) -> DataFrame:
    """One row per piece of line evidence of each block (hyphenation, page_number, numbered, line)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for b, d, p, ocr, h, a, text in zip(*(pdf[c] for c in ("block_id", "doc_id", "page_num", "ocr", "heading", "apart", "text"))):
                page = None if p is None or p != p else int(p)
                if HYPHEN.search(text):
                    out.append((b, d, page, ocr, h, False, "hyphenation", "", ""))
                apart = a and "\n" not in text.strip()
                out += [(b, d, page, ocr, h, apart and k in ("line", "numbered"), k, key, line) for k, key, line in line_evidence(text, page)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _EVIDENCE.split(", ")]).astype({"page_num": "Int32"})

    b = blocks.where(F.col("text").isNotNull() & F.col("block_id").isNotNull()).select("block_id", "doc_id", "page_num", F.coalesce(F.col("extraction_method").isin("ocr", "mixed"), F.lit(False)).alias("ocr"), F.coalesce(F.col("block_kind") == "heading", F.lit(False)).alias("heading"), F.coalesce((F.col("block_kind") == "unknown") & (F.col("block_role") == "footer_header_noise"), F.lit(False)).alias("apart"), "text")
    return b.mapInPandas(run, _EVIDENCE)


def headers(lines: DataFrame, least_pages: int = 2, least_share: float = 0.15) -> DataFrame:
    """doc_id, key of the lines that repeat over the pages of a PDF.

    (A block of one line that the extractor set apart as a header counts without
    repetition; see header_lines.) A line is a header when it stands on ``least_pages`` pages and a share of
    ``least_share`` of the pages that have lines, or twice beside a page number.
    """
    at = lines.where("key <> ''").groupBy("doc_id", "key", "page_num").agg(F.max(F.col("kind") == "numbered").alias("numbered"))
    per = at.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.count_if("numbered").alias("n_numbered"))
    pages = lines.select("doc_id", "page_num").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    j = salted_lookup(per.where(F.col("n") >= least_pages), pages, ["doc_id"], "key", "inner")
    return j.where((F.col("n") >= least_share * F.col("n_pages")) | (F.col("n_numbered") >= 2)).select("doc_id", "key")


def header_lines(ev: DataFrame) -> DataFrame:
    """The evidence rows whose line is a header; keys are salted since one PDF may hold a third of all rows."""
    lines = ev.where(F.col("kind").isin("numbered", "line"))
    real = salted_lookup(lines, headers(lines), ["doc_id", "key"], "block_id", "left_semi").select(*ev.columns).unionByName(lines.where("apart"))
    return real.where((F.col("kind") == "numbered") | ~(F.col("heading") & (F.col("page_num") == 0))).select(*ev.columns)


def scanned_only(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of scanned blocks: by their method (``ocr``), or because the page was read by OCR."""
    p = pages.where("ocr_used").select("doc_id", "page_num").where("doc_id is not null and page_num is not null").distinct().withColumn("page_ocr", F.lit(True))
    return rows.where("ocr").unionByName(rows.where("not ocr").join(p, ["doc_id", "page_num"], "left_semi").select(*rows.columns))


def misread_blocks(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """block_id, doc_id, page_num, ocr, w, prev, next: each mis-read word where it stands.

    ``words``: w. One pass over the texts, whatever the number of words: tokens
    that a fixed-size bitmap of the words lets through are joined to the words,
    with frequent words spread over salts.
    """
    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(h=pd.util.hash_array(pdf["w"].to_numpy(object), categorize=False).view(np.int64))

    one = words.select("w").distinct()
    bitmap = key_bitmap(one.mapInPandas(hashes, "w string, h long"), "h")
    schema = "block_id string, doc_id string, page_num int, ocr boolean, w string, prev string, next string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")
        for pdf in batches:
            per = [tokens(t) for t in pdf["text"]]
            flat = np.array([w for ws in per for w in ws], dtype=object)
            if not len(flat):
                continue
            owner = np.repeat(np.arange(len(per)), [len(ws) for ws in per])
            at = np.flatnonzero(in_bitmap(bits, pd.util.hash_array(flat, categorize=True)))
            rows = pdf[["block_id", "doc_id", "page_num", "ocr"]].iloc[owner[at]].reset_index(drop=True)
            before, after = np.r_[[""], flat[:-1]], np.r_[flat[1:], [""]]
            before[np.r_[True, owner[1:] != owner[:-1]]] = ""
            after[np.r_[owner[1:] != owner[:-1], True]] = ""
            yield rows.assign(w=flat[at], prev=before[at], next=after[at]).astype({"page_num": "Int32"})

    b = blocks.where(F.col("text").isNotNull() & F.col("block_id").isNotNull()).select("block_id", "doc_id", "page_num", F.coalesce(F.col("extraction_method").isin("ocr", "mixed"), F.lit(False)).alias("ocr"), "text")
    found = b.mapInPandas(run, schema).withColumn("_salt", F.pmod(F.xxhash64("block_id"), F.lit(_SALTS)).cast("int"))
    return found.join(one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))), ["w", "_salt"], "left_semi").select("block_id", "doc_id", "page_num", "ocr", "w", "prev", "next")


def damage(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """block_id, noise_kind of every scanned block: hyphenation, misread, running_header, page_number.

    Null texts and blocks show no noise; a null page_num has no page number of
    its own. Redelivered blocks and repeated pages give each row once.
    """
    ev = cut_lineage(evidence(blocks))
    lines = ev.where(F.col("kind").isin("hyphenation", "page_number")).select("block_id", "doc_id", "page_num", "ocr", F.col("kind").alias("noise_kind"))
    head = header_lines(ev).select("block_id", "doc_id", "page_num", "ocr", F.lit("running_header").alias("noise_kind"))
    mis = cut_lineage(misreadings(word_counts(blocks)))
    bad = misread_blocks(blocks, mis).select("block_id", "doc_id", "page_num", "ocr", F.lit("misread").alias("noise_kind"))
    return scanned_only(lines.unionByName(head).unionByName(bad), pages).select("block_id", "noise_kind").distinct()


# --- repair --------------------------------------------------------------------


def context_counts(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """a, b, n: corpus bigrams in which a candidate word stands, from pages that were not scanned."""
    b = blocks.where((F.col("extraction_method") == "native") & F.col("text").isNotNull())
    at = misread_blocks(b, words)
    left = at.select(F.col("prev").alias("a"), F.col("w").alias("b"))
    right = at.select(F.col("w").alias("a"), F.col("next").alias("b"))
    return left.unionByName(right).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def corrections(blocks: DataFrame) -> DataFrame:
    """block_id, w, c: the word chosen for each mis-read word of a block.

    With one candidate that is it. Of several, the one with the best sum of
    frequency, bigrams with its neighbours and nearness is chosen.
    """
    mis = cut_lineage(misreadings(word_counts(blocks)))
    at = misread_blocks(blocks, mis)
    several = mis.groupBy("w").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("w")
    bi = context_counts(blocks, mis.join(several, "w", "left_semi").select(F.col("c").alias("w")))
    j = at.join(mis, "w")
    j = j.join(bi.select(F.col("a").alias("prev"), F.col("b").alias("c"), F.col("n").alias("n_left")), ["prev", "c"], "left")
    j = j.join(bi.select(F.col("a").alias("c"), F.col("b").alias("next"), F.col("n").alias("n_right")), ["next", "c"], "left")
    score = F.log1p("n_true") + 2 * F.log1p(F.coalesce("n_left", F.lit(0))) + 2 * F.log1p(F.coalesce("n_right", F.lit(0))) - 4 * F.col("distance")
    return j.groupBy("block_id", "w").agg(F.max_by("c", F.struct(score, "c")).alias("c"))


def _respell(word: str, fixes: dict[str, str]) -> str:
    c = fixes.get(word.lower())
    if c is None:
        return word
    return c.upper() if word.isupper() and len(word) > 1 else c[:1].upper() + c[1:] if word[:1].isupper() or (not word[:1].isalpha() and word[1:2].isupper()) else c


def readable(text: str, drop: set[str], fixes: dict[str, str]) -> str:
    """The text without the dropped lines, with line-end hyphens joined, words respelt, and wrapped lines run together."""
    lines = [x for x in text.split("\n") if x not in drop]
    t = HYPHEN.sub("", "\n".join(lines))
    if fixes:
        t = _TOKEN.sub(lambda m: _respell(m[0], fixes), t)
    out: list[str] = []
    for line in t.split("\n"):
        s = line.rstrip()
        if out and s and out[-1] and not re.match(r"\s*(?:[-*•☐☑|]|\(?\w{1,3}[.)]\s|\[[ xX]?\])", s) and len(out[-1]) > 30 and not re.search(r"[.!?:;]$|\s{3}|\t|\|", out[-1]):
            out[-1] += " " + s.lstrip()
        elif out and s and out[-1] and re.search(r"[.!?][\"”»’]*$", out[-1]) and len(out[-1]) > 30 and s[:1].isalpha():
            out[-1] += " " + s
        else:
            out.append(s)
    return "\n".join(out).strip("\n")


def repaired(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """block_id, doc_id, page_num, text, repaired of every scanned block, once per block.

    A block that is nothing but a header or page number becomes an empty text.
    """
    ev = cut_lineage(evidence(blocks))
    drop = ev.where("kind = 'page_number'").unionByName(header_lines(ev)).groupBy("block_id").agg(F.collect_set("line").alias("drop"))
    fix = corrections(blocks).groupBy("block_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "c"))).alias("fixes"))
    b = blocks.where(F.col("text").isNotNull() & F.col("block_id").isNotNull()).dropDuplicates(["block_id"]).select("block_id", "doc_id", "page_num", F.coalesce(F.col("extraction_method").isin("ocr", "mixed"), F.lit(False)).alias("ocr"), "text")
    j = scanned_only(b, pages).join(drop, "block_id", "left").join(fix, "block_id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r = [readable(t, set(d) if d is not None else set(), dict(f) if f is not None else {}) for t, d, f in zip(pdf["text"], pdf["drop"], pdf["fixes"])]
            yield pdf[["block_id", "doc_id", "page_num", "text"]].assign(repaired=r)

    return j.mapInPandas(run, "block_id string, doc_id string, page_num int, text string, repaired string")
