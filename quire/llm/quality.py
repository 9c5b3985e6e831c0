"""Text quality statistics per block and what they tell from prose.

Every statistic is a share in thousandths, high where a text is unlike prose.
Ranks are exact within a language: values are counted, range partitioned,
sorted and summed with partition offsets. The share of texts with a value at
least as high is its tail probability; the outlier score of a text is the sum
of the negative logs of its tails, each times the value, and decides alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.ranking import exact_ranks
from quire.session import cut_lineage

STATS = ("unsentenced", "marked", "labelled", "celled", "digits", "symbols", "short_lines", "uncommon", "repeated", "odd_words")
PLAIN = ("n_chars", "n_words", "n_lines", "mean_word_chars")
#: Frequent function words of each language.
COMMON = {
    "en": "the of and to in a is that for on with as by at from this which each every any no not never when if neither nor while before after within under into its it are was".split(),
    "fr": "le la les un une de des du et en dans pour par sur avec est que qui ce cette chaque notre ne pas lorsque depuis pendant selon après près".split(),
    "es": "el la los las un una de del y en para por con es que se este esta cada nuestra nuestro no si también durante según desde más".split(),
    "de": "der die das ein eine und in zu mit für von ist nicht den dem des diese dieser jede jeder unsere über während zwischen sobald gemäß".split(),
    "pt": "o a os as um uma de do da e em para por com é que não este esta cada nossa nosso então durante até às já".split(),
    "pl": "i w na z do nie się jest to ten każdy nasz oraz jeśli według między podczas dzięki oprócz przez również pierwszy ostatni".split(),
    "uk": "і в на з до не що це та цей кожний наш якщо під час між через також згідно перший останній".split(),
}
_LANGS = tuple(COMMON)
_SETS = {k: frozenset(v) for k, v in COMMON.items()}
_ALL = frozenset().union(*COMMON.values())
_MARK = re.compile(r"\s*(?:[-*•‣◦▪·☐☑☒✓□■○●+>–—]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(\w{1,3}\)|\[[ xX]?\])\s+\S")
_LABEL = re.compile(r"\s*(?:\[[ xX]?\]\s*)?[^:=_\n]{1,40}?(?:[^\s»]:(?:\s|$)|\s=\s|\s*\.{4,}|(?:\s\.){4,}|\s*_{3,})")
_CELL = re.compile(r"\t|(?:^|\s)\|(?=\s|$)|\S {3,}(?=\S)")
_CSV = re.compile(r"[^\s,],(?=[^\s,])|,,")
_END = re.compile(r"[.!?…。！？][\"'”“’»)\]]*$")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”“’»)]{0,2}\s+(?=[^\sa-z])")
_DIGITED = re.compile(r"[^\s\d]*\d\S*")
_CYRILLIC = re.compile("[а-ї]")
_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^\W\d_]*[bcdfghjklmnpqrstvwxz]{5}|.{26,}|\S*[{}<>\\^~#]|\(cid|(?:[0-9a-f]{2}|[0-9a-f]{8})$|[^\w\s]{3,}$|[^\w\s]*[^\W\d_][^\w\s]+[^\W\d_]?$")


def language_of(words: list[str], cyrillic: bool) -> str:
    """The language most function words speak for; Cyrillic is uk; without evidence en."""
    if cyrillic:
        return "uk"
    n = Counter(words)
    score = [(sum(n[w] for w in _SETS[k] & n.keys()), -i) for i, k in enumerate(_LANGS)]
    best = max(score)
    return _LANGS[-best[1]] if best[0] else "en"


def _sentenced(lines: list[str], taken: list[bool]) -> int:
    """Words that stand in sentences of running text."""
    runs: list[list[str]] = [[]]
    for line, t in zip(lines, taken):
        if t:
            if runs[-1]:
                runs.append([])
        else:
            runs[-1].append(line)
    good = 0
    for run in runs:
        if not run:
            continue
        for part in _SPLIT.split(" ".join(run)):
            tokens = part.split()
            n = len(tokens)
            if n < 3:
                good += n if n and _END.search(part) and good else 0
                continue
            words = _WORD.findall(part.lower())
            if sum(map(len, words)) < 2.3 * n or len(set(part)) < 10 or 2 * sum(map((2).__lt__, map(len, tokens))) < n:
                continue
            common = sum(map(_ALL.__contains__, words))
            several = len(set(words)) * 3 > len(words)
            if several and (_END.search(part) if n >= 4 else common and _END.search(part)):
                good += n
            elif several and n >= 8 and common * 7 >= n:
                good += n
    return good


def block_statistics(text: str) -> tuple:
    """(language, n_chars, n_words, n_lines, mean_word_chars, STATS...) of one text."""
    tokens = text.split()
    n = len(tokens)
    lines = [x for x in text.split("\n") if x.strip()]
    k = len(lines)
    if not n:
        return ("en", len(text), 0, 0, 0.0, *[0] * len(STATS))
    low = text.lower()
    words = _WORD.findall(low)
    letters = sum(map(len, words))
    cyr = 0 if low.isascii() else len(_CYRILLIC.findall(low))
    lang = language_of(words, cyr * 2 > letters)
    marked = [bool(_MARK.match(x)) for x in lines]
    if k >= 3:
        prefix, times = Counter(x.lstrip()[:2] for x in lines).most_common(1)[0]
        if times * 2 > k and not prefix.isalnum():
            marked = [m or x.lstrip()[:2] == prefix for m, x in zip(marked, lines)]
    n_marked = sum(marked)
    if n_marked * 3 < k or (n_marked == 1 and k > 1):  # a stray dash or number at the wrap of a line
        marked = [False] * k
    parts = lines if k > 1 else [x for x in text.split(";") if x.strip()]
    is_label = [bool(m) and len(x[m.end() :].split()) <= 5 for x in parts for m in [_LABEL.match(x)]]
    labelled = sum(is_label)
    if labelled * 2 < len(parts) or (labelled == 1 and len(parts) > 1):  # a sentence may open like a label
        is_label = [False] * len(parts)
    cells = [len(_CELL.findall(x)) for x in lines]
    csv = [len(_CSV.findall(x)) for x in lines]
    celled = [c >= 2 or v >= 2 or (c == 1 and k >= 3) or (v == 1 and k >= 3) for c, v in zip(cells, csv)]
    if sum(celled) * 3 < k:
        celled = [c >= 2 or v >= 2 for c, v in zip(cells, csv)]
    taken = [a or b or c for a, b, c in zip(marked, is_label if k > 1 else [labelled >= 2], celled)]
    good = _sentenced(lines, taken)
    short = sum(len(x.split()) <= 3 and not _END.search(x.rstrip()) for x in lines) if k >= 3 else 0
    odd = sum(map(bool, map(_ODD.match, tokens)))
    common = sum(map(_SETS[lang].__contains__, words))
    digits = len(_DIGITED.findall(text))
    spaces = sum(map(len, tokens))
    share = lambda a, b: 0 if not b else min(1000, round(1000 * a / b))
    return (
        lang, len(text), n, k, round(spaces / n, 3),
        1000 - share(good, n), share(sum(marked), k), share(labelled, len(parts)), share(sum(celled), k), share(digits, n), share(spaces - letters, spaces),
        share(short, k), 1000 - share(common, max(1, len(words))), share(len(tokens) - len(set(tokens)), n) if n >= 8 else 0, share(odd, n),
    )


_SCHEMA = "lang string, n_chars int, n_words int, n_lines int, mean_word_chars double, " + ", ".join(f"{s} int" for s in STATS)


def statistics(blocks: DataFrame, keep: tuple[str, ...] = ("block_id", "block_kind")) -> DataFrame:
    """The kept columns and the statistics of every block with a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _SCHEMA.split(", ")]
        for pdf in batches:
            stats = pd.DataFrame([block_statistics(t) for t in pdf["text"]], columns=names, index=pdf.index)
            yield pd.concat([pdf.drop(columns="text"), stats], axis=1)

    b = blocks.where(F.col("text").isNotNull()).select(*keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in b.drop("text").schema) + ", " + _SCHEMA
    return b.mapInPandas(run, schema)


#: The tails of a language are drawn to those of all texts as if it had so many more texts that lie like all: smooth, so that no count switches anything.
PRIOR_TEXTS = 200
#: Fixed weights: the share of words outside sentences speaks of prose itself, the others of what stands in its place.
WEIGHTS = {"unsentenced": 2.0}
#: Where the scores of prose and of everything else part in the invented tables.
LEAST_SCORE = 5.5


def tails(stats: DataFrame, names: tuple[str, ...] = STATS) -> DataFrame:
    """lang, tails: for each language, per statistic (by its place in ``names``), the negative log tail of each of its values.

    The size is bounded by languages x statistics x 1001 values, whatever the input.
    """
    long = stats.select("lang", F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(s).alias("value")) for i, s in enumerate(names)])).alias("x")).select("lang", "x.stat", "x.value")
    counts = cut_lineage(long.groupBy("lang", "stat", "value").agg(F.count(F.lit(1)).alias("n")))
    own = exact_ranks(counts, ["lang", "stat"], "value", "n")
    pooled = exact_ranks(counts, ["stat"], "value", "n").select("stat", "value", ((F.col("n_group") - F.col("n_below")) / F.col("n_group")).alias("pool"))
    tail = (F.col("n_group") - F.col("n_below") + PRIOR_TEXTS * F.col("pool")) / (F.col("n_group") + PRIOR_TEXTS)
    nlog = own.join(F.broadcast(pooled), ["stat", "value"]).select("lang", "stat", "value", (-F.log(tail)).alias("nlog"))  # statistics x 1001 rows
    per = nlog.groupBy("lang", "stat").agg(F.map_from_entries(F.collect_list(F.struct("value", "nlog"))).alias("m"))
    return per.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("stat", "m"))).alias("tails"))


def scored(stats: DataFrame, names: tuple[str, ...] = STATS) -> DataFrame:
    """The statistics with ``outlier_score``: the sum over ``names`` of value (as a share) x weight x negative log tail.

    A value counts by how rare it is in its language and by how far it goes: half a
    text out of sentences tells less than a whole one, though both may be as rare.
    """
    t = F.broadcast(tails(stats, names))  # languages x statistics x 1001 values at most
    j = stats.join(t, "lang")
    score = F.lit(0.0)
    for i, s in enumerate(names):
        score = score + F.col(s) / 1000 * WEIGHTS.get(s, 1.0) * F.element_at(F.element_at("tails", F.lit(i)), F.col(s))
    return j.withColumn("outlier_score", F.round(score, 6)).drop("tails")


def not_prose(blocks: DataFrame, least_score: float = LEAST_SCORE, least_chars: int = 80) -> DataFrame:
    """Blocks stored as text (or as nothing) that aren't running prose, with statistics and score, once per block.

    A block is a case when its outlier score reaches ``least_score``; nothing
    else decides. Null, empty and short texts are no cases. Redeliveries count in
    the ranks as often as they come.
    """
    b = blocks.where((F.col("block_kind").isNull() | (F.col("block_kind") == "text")) & (F.length("text") >= least_chars))
    return scored(cut_lineage(statistics(b))).where(F.col("outlier_score") >= least_score).dropDuplicates(["block_id"])
