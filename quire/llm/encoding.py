"""Texts that were decoded with a wrong character encoding.

From the text as it stands a best-first search goes over the texts that
encoding, decoding and unescaping steps reach. A state is visited once (by
hash); the cost of a state counts characters and neighbours that no language
of the corpus writes. The cheapest state reached is the restored text.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 bytes get read in by mistake.
_UTF8_AS = ("cp1252", "cp1250", "cp1251", "mac_roman", "cp437", "iso8859_2", "cp850", "koi8_u", "cp1254", "cp866")
#: (wrongly read as, really) pairs of single-byte encodings.
_SWAPS = (
    ("cp1251", "koi8_u"), ("koi8_u", "cp1251"), ("cp1252", "cp1251"), ("cp1252", "koi8_u"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("mac_roman", "cp1251"), ("cp1251", "mac_cyrillic"), ("mac_cyrillic", "cp1251"),
    ("cp1252", "cp1250"), ("cp1250", "cp1252"), ("cp1252", "iso8859_2"), ("cp1250", "iso8859_2"), ("iso8859_2", "cp1250"), ("iso8859_2", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("mac_roman", "cp1250"), ("cp1251", "cp1252"), ("cp1251", "cp1250"), ("cp850", "cp1250"),
)
_MULTI = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _table(codec: str) -> dict[int, int]:
    """Characters of a single-byte encoding to their bytes; bytes it leaves undefined stand for themselves."""
    t = {}
    for b in range(128, 256):
        c = bytes([b]).decode(codec, "ignore")
        t[ord(c) if c else b] = b
    return t


_TO_BYTES = {c: _table(c) for c in {*_UTF8_AS, *(a for a, _ in _SWAPS)}}
_FROM_BYTES = {c: {b: u for u, b in _table(c).items()} for c in {b for _, b in _SWAPS}}
_SWAP_TABLES = {(a, b): {u: _FROM_BYTES[b].get(x, x) for u, x in _TO_BYTES[a].items()} for a, b in _SWAPS}


def _utf8_step(codec: str) -> Callable[[str], str]:
    # bytes as characters below 256; what the encoding cannot hold is moved out of their way
    table = {o: chr(_TO_BYTES[codec].get(o, o if o < 160 else 0xF0000 + o)) for o in range(128, 256)}
    table.update({u: chr(b) for u, b in _TO_BYTES[codec].items()})

    def step(text: str) -> str:
        mapped = text.translate(table)
        out, at = [], 0
        for m in _MULTI.finditer(mapped):
            try:
                c = m[0].encode("latin-1").decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [text[at : m.start()], c]
            at = m.end()
        return "".join([*out, text[at:]]) if out else text

    return step


def _swap_step(pair: tuple[str, str]) -> Callable[[str], str]:
    table = _SWAP_TABLES[pair]
    return lambda text: text.translate(table)


def _part_step(pair: tuple[str, str]) -> Callable[[str], str]:
    """The swap from the first to the last word that it makes more plausible; the rest stays."""
    table = _SWAP_TABLES[pair]

    def step(text: str) -> str:
        words = [m for m in re.finditer(r"\S+", text) if not m[0].isascii()]
        better = [m for m in words if cost(m[0].translate(table)) < cost(m[0])]
        if not better or len(better) == len(words):
            return text
        a, b = better[0].start(), better[-1].end()
        return text[:a] + text[a:b].translate(table) + text[b:]

    return step


#: Swaps that are also tried on a part of the text.
_PARTS = (("cp1251", "koi8_u"), ("cp1252", "cp1251"), ("cp1252", "koi8_u"))
_UNICODE_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")


def _unescape(text: str) -> str:
    t = html.unescape(text) if "&" in text else text
    return _UNICODE_ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), t) if "\\" in t else t


STEPS: dict[str, Callable[[str], str]] = {
    **{f"utf8<{c}": _utf8_step(c) for c in _UTF8_AS},
    **{f"{b}<{a}": _swap_step((a, b)) for a, b in _SWAPS},
    **{f"part:{b}<{a}": _part_step((a, b)) for a, b in _PARTS},
    "unescape": _unescape,
}

# --- the cost ------------------------------------------------------------------

#: What the corpus' languages write beyond ASCII.
_LATIN = "àâäáãåæçèéêëìíîïñòóôöõøœùúûüÿßąćęłńśźż"
_CYRILLIC = "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя"
_MARKS = "¬–—“”’„‘…•°€«»¿¡☐☑☒✓№­‐‑ﬁﬂﬀﬃﬄ§©®±×²³½·≈≥≤→\xa0"
_KNOWN = _LATIN + _LATIN.upper() + _CYRILLIC + _CYRILLIC.upper() + _MARKS
#: Characters that need no closer look when a text holds no other.
_SAFE = frozenset(map(chr, range(32, 127))) | frozenset("\n\t\r") | frozenset(_LATIN + _LATIN.upper() + "–—“”’„…•°€«»¿¡☐☑\xadﬁ‐≈≥№") - frozenset("ÃÂâßÀÎÏÐÑÒÓÔÅÄ¬ÖØ")
_ODD_CHARS = re.compile(f"[^\\x00-\\x7f{re.escape(_KNOWN)}\u3000-\u303f\u4e00-\u9fff\uff00-\uffef]")
#: A symbol inside or at the rim of what should be a word; leads of UTF-8 sequences before what they lead.
_INSIDE = re.compile("(?<=[^\\W\\d_])[¢£¥§¨©ª«¬¯±²³´µ¶·¸¹º¼½¾×÷†‰‹›™≈≤≥∆√∂Ωπ∑∏€‚„…“”°¿¡](?=[^\\W\\d_])|[ÃÂ][^\\sa-zA-ZÀ-ÿ,.;:!?)\"”]|Â[ «»°¿]|(?<![A-ZÀ-Þ])Ã |â[€„‚˜]|‚[ÄÅòÑ]|(?<=[a-zà-ÿа-яіїєґ])[³¼¾¢£¥§¨©±´µ¶·¸](?=[\\s,.]|$)|(?<![^\\W\\d_])[¹³¼¾ªº©§¶±](?=[a-zà-ÿ])")
_CASE = re.compile("[a-zà-öø-ÿа-яіїєґąćęłńśźż][A-ZÀ-ÖØ-ÞА-ЯІЇЄҐĄĆĘŁŃŚŹŻ]")
_MIXED = re.compile("[A-Za-zÀ-ÿ][А-яіїєґІЇЄҐ]|[А-яіїєґІЇЄҐ][A-Za-zÀ-ÿ]|[^\\W\\d_\u4e00-\u9fff][\u4e00-\u9fff]|[\u4e00-\u9fff][^\\W\\d_\u4e00-\u9fff]")
_RUNS = re.compile("[бвгґджзклмнпрстфхцчшщБВГҐДЖЗКЛМНПРСТФХЦЧШЩ]{6,}|[ыэёъЫЭЁЪ]|[àâäáãåæçèéêëìíîïñòóôöõøœùúûüýÿßÀ-ÿ]{3,}|(?<=[А-ЯІЇЄҐ]{2})[а-яіїєґ](?=[А-ЯІЇЄҐ])")
_CYR_TEXT = re.compile("[А-яіїєґІЇЄҐ]")
_CYR_VOWELS = re.compile("[аеєиіїоуюяАЕЄИІЇОУЮЯ]")


def cost(text: str) -> float:
    """How implausible the characters of a text are; 0 for what the languages of the corpus write."""
    if text.isascii() or _SAFE.issuperset(text):
        return 0.0
    c = 2.0 * len(_ODD_CHARS.findall(text)) + len(_INSIDE.findall(text)) + 0.7 * len(_CASE.findall(text)) + len(_MIXED.findall(text)) + 0.7 * len(_RUNS.findall(text))
    n = len(_CYR_TEXT.findall(text))
    if n >= 4:
        share = len(_CYR_VOWELS.findall(text)) / n
        if share < 0.3:
            c += (0.3 - share) * n
    return c


#: A decoding step that undoes a wrong one takes away most of what that one made; lesser falls come by chance and would make the graph endless.
LEAST_FALL = 0.6


def restore(text: str) -> tuple[float, float, str, tuple[str, ...]]:
    """(cost removed, cost left, restored text, steps) by best-first search.

    States are texts; an edge is a decoding step that lowers the cost to
    LEAST_FALL of what it was, which bounds the graph whatever the text, or an
    unescape step, which may raise it, since what it opens may be garbled. A
    state is visited once. The queue is ordered by cost plus a small charge per
    step and runs until it is empty or its first text has cost 0 and nothing to
    open, so of equally plausible texts the one nearest to the input wins. What
    the decoding steps of a path removed from the cost decides which text is
    best. Replacement characters cannot be restored and cost nothing here.
    """
    first = cost(text.replace("�", ""))
    best = (0.0, first, text, ())
    queue: list[tuple[float, int, str, tuple[str, ...], float, float]] = [(first, 0, text, (), first, 0.0)]
    seen = {hash(text)}
    pushed = 0
    while queue:
        _, _, state, steps, c, gone = heapq.heappop(queue)
        for name in (STEPS if c > 0 else ("unescape",)):
            reached = STEPS[name](state)
            h = hash(reached)
            if h in seen:
                continue
            seen.add(h)
            r = cost(reached.replace("�", ""))
            opened = name == "unescape"
            if not opened and r > LEAST_FALL * c:
                continue
            path, removed = (*steps, name), gone if opened else gone + c - r
            if removed > best[0]:
                best = (removed, r, reached, path)
            pushed += 1
            # valid UTF-8 hardly ever comes about by chance, a swap of single bytes always works
            sure = 0.3 if all(x.startswith("utf8") for x in path) else 1.0
            heapq.heappush(queue, (sure * r + 0.3 * len(path), pushed, reached, path, r, removed))
            if removed > 0 and r == 0 and _unescape(reached) == reached:
                return removed, r, reached, path
    return best


def wrongly_decoded(text: str, least_gain: float = 1.0) -> tuple[bool, str | None, str, float, float]:
    """(affected, restored text or null, steps, cost removed, cost left) of one text.

    A text is affected when decoding steps remove ``least_gain`` and at least
    half of the cost, or when it holds replacement characters. It is restored
    when the steps leave next to nothing implausible.
    """
    removed, after, out, steps = restore(text)
    lost = "�" in text
    gained = removed >= least_gain and after <= removed
    if not (gained or lost):
        return False, None, "", removed, after
    whole = gained and not lost and after <= removed / 9
    return True, out if whole else None, " ".join(steps), removed, after


#: Nothing else can be affected: a text needs a character that wrong decoding makes, or an escape that may stand for one.
SUSPECT = r"[^\x00-\x7F]|&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z]{2,8}\d{0,2});|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}"
SCHEMA = "affected boolean, restored string, steps string, cost_removed double, cost_left double"


def repaired(blocks: DataFrame, keep: tuple[str, ...] = ("block_id",)) -> DataFrame:
    """The kept columns, and restored, steps, cost_removed, cost_left of each affected text.

    Null and empty texts, and ASCII texts without escapes, are never affected. ``restored`` is null
    where characters were lost. Each row is judged alone: there is no shuffle.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            r = pd.DataFrame([wrongly_decoded(t) for t in pdf["text"]], columns=names, index=pdf.index)
            yield pd.concat([pdf.drop(columns="text"), r], axis=1)[r["affected"]]

    b = blocks.where(F.col("text").isNotNull() & F.col("text").rlike(SUSPECT)).select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in b.drop("text").schema) + ", " + SCHEMA
    return b.mapInPandas(run, schema).drop("affected")
