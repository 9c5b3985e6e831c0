"""Texts cut off by field limits or broken transfers.

A field limit leaves a spike in the length distribution of its source. For each
source the discrete length hazard h(L) = P(length = L | length >= L), of
characters and of UTF-8 bytes, is computed with window functions over the
length histogram and tested against the pooled hazard of the neighbouring
lengths; false discoveries are controlled over all tests. A text at a
significant length is cut when its ending is incomplete. At other lengths an
ending counts as incomplete only on the evidence of the corpus itself: a last
word that is no word elsewhere but begins one, or that never ends a sentence,
line or cell.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.joins import salted_lookup
from quire.operators.ranking import exact_ranks
from quire.session import cut_lineage

#: Traces that a cut leaves: replacement character, bracketed or attached dots, an opened tag, a hanging hyphen.
TRACE = r"(?:�+|\s*\[(?:\.\.\.|…)\]|(?<=\S)(?:\.\.\.|…)|<[^<>\n]{0,12}|(?<=\p{L})[-‐])\s*$"
#: A finished end: a terminator, perhaps followed by closing quotes or brackets.
FINISHED = r"[.!?。！？;:][\"'”“»’)\]]*\s*$"
#: Chars of the end that the ending patterns look at; longer than any of them can match.
_TAIL = 120
_WORD_BATCH = 300_000
#: A last line that, beyond doubt of chance (two standard deviations), one in so many of the texts without a finished end share is a closing formula, not a cut.
_FORMULA_ONE_IN = 1000
#: Rarer than one in so many words of the corpus: as good as never seen, whatever the size of the corpus.
_RARE_ONE_IN = 400_000
#: A word at least one in so many counts as a word that others may be the beginning of; no more than so many words can be.
_KNOWN_ONE_IN = 500_000


def source_name(source: Column) -> Column:
    """Sources are written unevenly: blanks and case don't count; null stays null."""
    return F.lower(F.trim(source))


def length_hazards(lengths: DataFrame, reach: int = 60, gap: int = 4) -> DataFrame:
    """Hazard of every (source, measure, length) and of its neighbours.

    ``lengths``: source, measure, length, n (texts of that length). The
    neighbours are the lengths within ``reach`` but farther than ``gap``. The
    windows run over the distinct lengths of a source, which its longest text bounds.
    """
    by = Window.partitionBy("source", "measure")
    down = by.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    near = by.orderBy("length").rangeBetween(-reach, reach)
    inner = by.orderBy("length").rangeBetween(-gap, gap)
    r = lengths.withColumn("at_risk", F.sum("n").over(down))
    span = (F.sum("n").over(near) - F.sum("n").over(inner)).alias("near_n")
    # the at-risk number is nearly constant over the reach, so exposure = lengths looked at x at risk here
    return r.select("*", span).withColumn("near_hazard", (F.col("near_n") + F.lit(0.5)) / (F.lit(2.0 * (reach - gap)) * F.col("at_risk")))


def significant_lengths(lengths: DataFrame, fdr: float = 0.001, least: int = 5) -> DataFrame:
    """source, measure, length, n, at_risk, hazard, p_bound of the lengths with too high a hazard.

    The p-value is the Chernoff bound of the Poisson tail, so it errs to the safe
    side; Benjamini-Hochberg over all lengths of all sources, with ranks from a
    range-partitioned sort. Lengths with fewer than ``least`` texts are tested
    but never reported.
    """
    h = length_hazards(lengths).withColumn("hazard", F.col("n") / F.col("at_risk"))
    mu = F.col("near_hazard") * F.col("at_risk")
    log_p = F.when(F.col("n") > mu, -(F.col("n") * F.log(F.col("n") / mu) - F.col("n") + mu)).otherwise(F.lit(0.0))
    h = cut_lineage(h.withColumn("log_p", F.round(log_p, 6)))
    ranks = exact_ranks(h.select("log_p", F.lit(1).alias("w"), F.lit("all").alias("g")), ["g"], "log_p", "w")
    passed = ranks.where(F.col("log_p") <= F.log(F.lit(fdr) * F.col("n_at_or_below") / F.col("n_group")))
    limit = passed.agg(F.max("log_p").alias("limit"))  # one row
    return h.crossJoin(F.broadcast(limit)).where((F.col("log_p") <= F.col("limit")) & (F.col("n") >= least)).select("source", "measure", "length", "n", "at_risk", "hazard", F.exp("log_p").alias("p_bound"))


def unexplained_lengths(docs: DataFrame, fdr: float = 0.001, least: int = 5) -> DataFrame:
    """The significant lengths without by-products: a limit in chars makes lesser spikes in bytes, and the other way round.

    A length counts as a by-product when at least half of its texts stand at a
    significant length of the other measure that more texts stand at.
    """
    sig = cut_lineage(significant_lengths(length_histogram(docs), fdr, least))
    both = docs.where(F.col("text").isNotNull() & F.col("source").isNotNull()).groupBy(source_name(F.col("source")).alias("source"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes")).agg(F.count(F.lit(1)).alias("n_both"))
    pick = lambda m: sig.where(F.col("measure") == m).select("source", F.col("length").alias(m), F.col("n").alias(f"n_{m}"))
    b = both.join(pick("chars"), ["source", "chars"], "left").join(pick("bytes"), ["source", "bytes"], "left").na.fill(0, ["n_chars", "n_bytes"])
    by = [b.where(F.col(f"n_{m}") > 0).groupBy("source", F.lit(m).alias("measure"), F.col(m).alias("length")).agg(F.sum(F.when(F.col(f"n_{o}") > F.col(f"n_{m}"), F.col("n_both")).otherwise(0)).alias("explained")) for m, o in (("chars", "bytes"), ("bytes", "chars"))]
    return sig.join(by[0].unionByName(by[1]), ["source", "measure", "length"]).where(F.col("explained") * 2 < F.col("n")).drop("explained")


def length_histogram(docs: DataFrame) -> DataFrame:
    """source, measure (chars, bytes), length, n over all texts with a source and a text."""
    t = docs.where(F.col("text").isNotNull() & F.col("source").isNotNull()).select(source_name(F.col("source")).alias("source"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    long = t.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("measure"), F.col("bytes").alias("length")))).alias("x"))
    return long.select("source", "x.measure", "x.length").groupBy("source", "measure", "length").agg(F.count(F.lit(1)).alias("n"))


_TOKEN = re.compile(r"[^\W\d_]+(?: (?=[\w(“«„\"]))?")


def word_ends(docs: DataFrame) -> DataFrame:
    """w (lower case), n_mid, n_end: how often a word is followed by another, and how often it ends a sentence, line or cell.

    The last word of each text is left out, since it may be cut. Counts are
    summed per task before the shuffle.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()

        def out() -> pd.DataFrame:
            df = pd.DataFrame({"t": list(seen.keys()), "n": list(seen.values())})
            seen.clear()
            return df

        for pdf in batches:
            for text in pdf["text"]:
                seen.update(_TOKEN.findall(text.lower())[:-1])
            if len(seen) > _WORD_BATCH:
                yield out()
        yield out()

    c = docs.where(F.col("text").isNotNull()).select("text").mapInPandas(count, "t string, n long")
    return c.groupBy(F.rtrim("t").alias("w")).agg(F.sum(F.when(F.col("t").endswith(" "), F.col("n")).otherwise(0)).alias("n_mid"), F.sum(F.when(F.col("t").endswith(" "), 0).otherwise(F.col("n"))).alias("n_end"))


def endings(docs: DataFrame) -> DataFrame:
    """doc_id, source, chars, bytes, trace, finished, last word and the line it stands in, for texts that don't end finished."""
    full = F.col("text")
    t = F.right(full, F.lit(_TAIL))  # a cut shows at the end; patterns run over no more than that
    base = F.regexp_replace(t, TRACE, "")
    line = F.substring_index(F.regexp_replace(F.regexp_replace(full, r"\s+\z", ""), TRACE.replace(r"\s*$", r"\z"), ""), "\n", -1)
    cols = docs.where(full.isNotNull() & full.rlike(r"\S")).select(
        "doc_id",
        source_name(F.col("source")).alias("source"),
        F.length(full).alias("chars"),
        F.octet_length(full).alias("bytes"),
        F.xxhash64(full).alias("text_hash"),
        t.rlike(TRACE).alias("trace"),
        t.rlike(r"\s(?:\.\.\.|…)\s*$").alias("free_dots"),
        t.rlike(r"(?:[\p{L}\d,] |[\p{L}]­)$").alias("open_blank"),
        line.alias("line"),
        base.rlike(FINISHED).alias("finished"),
        F.regexp_extract(base, r"(\p{L}+)[\s­]*$", 1).alias("last"),
    )
    return cols.where(~F.col("finished") | F.col("trace") | F.col("free_dots"))


def truncated(docs: DataFrame, end_rate: float = 0.02, surest_end_rate: float = 0.1) -> DataFrame:
    """doc_id, source, reason of every cut text, once per doc_id.

    ``reason``: ``limit`` (incomplete at a significant length), ``trace`` (a
    trace of the cut after an unfinished end), ``word`` (ends inside a word),
    ``sentence`` (ends on a word that never ends anything: its end rate is at
    most ``end_rate``, and at 95 % confidence at most ``surest_end_rate``). Words
    and lines are judged by rates of the corpus and their confidence, never by
    counts, so more rows of the same kind change no verdict but by making it
    surer. Null and blank texts are never cut; a null source has no limits of its own.
    """
    sig = cut_lineage(unexplained_lengths(docs).select("source", "measure", "length"))
    e = cut_lineage(endings(docs))
    by = lambda m, name: sig.where(F.col("measure") == m).select("source", F.col("length").alias(m), F.lit(True).alias(name))
    e = salted_lookup(e, by("chars", "at_chars"), ["source", "chars"], "doc_id")
    e = salted_lookup(e, by("bytes", "at_bytes"), ["source", "bytes"], "doc_id")
    words = cut_lineage(word_ends(docs))
    n_words = words.agg(F.sum(F.col("n_mid") + F.col("n_end"))).first()[0] or 0
    prefixes = words.where((F.col("n_mid") + F.col("n_end")) * _KNOWN_ONE_IN >= n_words).select(F.explode(F.expr("transform(sequence(1, greatest(length(w) - 1, 1)), i -> substr(w, 1, i))")).alias("w"), (F.col("n_mid") + F.col("n_end")).alias("n")).groupBy("w").agg(F.sum("n").alias("n_longer"))
    tails = words.where(F.length("w") >= 4).groupBy(F.expr("right(w, 3)").alias("tail")).agg(F.sum(F.col("n_mid") + F.col("n_end")).alias("n_tail"))
    lines = e.groupBy("line").agg(F.count_distinct("text_hash").alias("n_line"))
    open_texts = lines.agg(F.sum("n_line").alias("n_open"))  # one row; a text has one last line
    formulas = lines.crossJoin(F.broadcast(open_texts)).where((F.col("n_line") - 2 * F.sqrt("n_line")) * _FORMULA_ONE_IN >= F.col("n_open")).select("line", F.lit(True).alias("formula"))
    e = salted_lookup(e, formulas, ["line"], "doc_id").na.fill(False, ["formula"])
    j = e.withColumn("w", F.lower("last")).withColumn("tail", F.expr("right(w, 3)"))
    j = salted_lookup(j, words.join(prefixes, "w", "full"), ["w"], "doc_id")
    j = salted_lookup(j, tails, ["tail"], "doc_id").withColumn("n_words", F.lit(n_words))
    j = j.na.fill(0, ["n_mid", "n_end", "n_longer", "n_tail", "n_words"]).na.fill(False, ["at_chars", "at_bytes"])
    n = F.col("n_mid") + F.col("n_end")
    lower = F.col("last") == F.lower("last")
    prose = F.size(F.split(F.trim("line"), " ")) >= 4
    # rarer than a fiftieth of the words it begins: no word of its own; counts only against counts, so that size doesn't matter
    inside = (F.col("last") != "") & lower & (F.col("n_longer") > 0) & (n * 50 < F.col("n_longer"))
    odd_name = (F.col("last") != "") & ~lower & (n * _RARE_ONE_IN < F.col("n_words")) & (F.col("n_tail") * _RARE_ONE_IN < F.col("n_words")) & (F.length("last") < 6) & prose
    open_word = (F.col("last") != "") & lower & prose & (F.col("n_end") < end_rate * n) & (F.col("n_end") + 3 <= surest_end_rate * n)  # 3: the 95 % bound of no event
    open_han = F.col("line").rlike(r"[。！？][^。！？;；]*\p{IsHan}$") & ~F.col("line").rlike(r"^\s*(?:[-*•☐☑|(]|\d+[.)])")
    limit = (F.col("at_chars") | F.col("at_bytes")) & ~F.col("finished")
    reason = (
        F.when(limit, "limit")
        .when(F.col("trace") & ~F.col("finished") & ~F.col("free_dots"), "trace")
        .when(F.col("finished") | F.col("free_dots") | F.col("formula"), F.lit(None))
        .when(F.col("open_blank") & prose, "sentence")
        .when(inside | odd_name, "word")
        .when(open_word | open_han, "sentence")
    )
    return j.select("doc_id", "source", reason.alias("reason")).where(F.col("reason").isNotNull()).dropDuplicates(["doc_id"])


def truncation_rates(docs: DataFrame) -> DataFrame:
    """source, n_docs, n_cut, cut_rate and the counts by reason; null sources form one row."""
    cut = truncated(docs).select("doc_id", "reason")
    all_docs = docs.select("doc_id", source_name(F.col("source")).alias("source")).dropDuplicates(["doc_id"])
    j = all_docs.join(cut, "doc_id", "left")
    per = {r: F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("limit", "trace", "word", "sentence")}
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count("reason").alias("n_cut"), F.round(F.count("reason") / F.count(F.lit(1)), 6).alias("cut_rate"), *per.values())
