"""Queries of the training-data operators, and the SQL where SQL can say the same."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.llm import encoding, leakage, mixing, quality, scannoise, splitting, truncation
from quire.session import cut_lineage, table

_LIMITS = "(select chunk_strategy, min(max_chars) as max_chars from size_limits group by 1)"


def p1_found(spark, sf):
    return quality.not_prose(table(spark, sf, "page_blocks")).select("block_id")


def p1_statistics(spark, sf):
    return quality.statistics(table(spark, sf, "page_blocks")).dropDuplicates(["block_id"])


def p1_plain(spark, sf):
    """Counts that SQL can check: chars, words, digits, and lines that end in punctuation."""
    t = F.col("text")
    return table(spark, sf, "page_blocks").where(t.isNotNull()).select("block_id", F.length(t).alias("n_chars"), F.regexp_count(t, F.lit(r"[^ \t\n\r]+")).alias("n_words"), F.regexp_count(t, F.lit("[0-9]")).alias("n_digits"), F.regexp_count(t, F.lit(r"[.!?;:,](\n|$)")).alias("n_punctuated_lines")).distinct()


def p1_scores(spark, sf):
    b = table(spark, sf, "page_blocks")
    return quality.scored(cut_lineage(quality.statistics(b, ("block_id",)))).select("block_id", "lang", "outlier_score").dropDuplicates(["block_id"])


#: What p1_plain_scores ranks: shares in thousandths that SQL can compute too.
_PLAIN = ("digits", "blanks", "unended")


def p1_plain_scores(spark, sf):
    """Outlier scores over plain statistics, so that SQL can check ranks, tails and sums."""
    t = F.col("text")
    b = table(spark, sf, "page_blocks").where(F.length(t) >= 80).select("block_id", "text").distinct()
    share = lambda a, n: F.least(F.lit(1000), F.floor(1000 * a / F.greatest(n, F.lit(1)))).cast("int")
    lines = F.regexp_count(t, F.lit(r"\n")) + 1
    stats = b.select("block_id", F.when(t.rlike("[а-яії]"), "uk").otherwise("latin").alias("lang"), share(F.regexp_count(t, F.lit("[0-9]")), F.length(t)).alias("digits"), share(F.regexp_count(t, F.lit(r"[ \t\n\r]")), F.length(t)).alias("blanks"), (1000 - share(F.regexp_count(t, F.lit(r"[.!?;:,](\n|$)")), lines)).alias("unended"))
    return quality.scored(cut_lineage(stats), _PLAIN).select("block_id", "lang", "outlier_score")


def p2_files(spark, sf):
    """Per strategy: the chars that the pieces of its texts, written as files, cover without overlaps; whether a piece is too long; whether an overlap differs from the end of the piece before."""
    limits = table(spark, sf, "size_limits")
    p = splitting.split_written(table(spark, sf, "chunk_records"), limits)
    p = splitting.with_limits(p, limits, "strategy")
    before = p.select("path", (F.col("piece_no") + 1).alias("piece_no"), (F.col("start") + F.length("piece_text")).alias("end_before"), F.col("piece_text").alias("text_before"))
    j = p.join(before, ["path", "piece_no"], "left")
    shared = F.when(F.col("piece_no") > 0, F.col("end_before") - F.col("start")).otherwise(0)
    wrong = (shared > 0) & (F.right("text_before", shared.cast("int")) != F.left("piece_text", shared.cast("int")))
    return j.groupBy("strategy").agg(F.sum(F.length("piece_text") - shared).alias("n_chars"), F.max(F.length("piece_text") > F.col("max_chars")).alias("too_long"), F.max(F.coalesce(wrong, F.lit(False))).alias("wrong_overlap"))


def p2_found(spark, sf):
    return splitting.oversized(table(spark, sf, "chunk_records"), table(spark, sf, "size_limits"))


def p2_pieces(spark, sf):
    return splitting.split_pieces(table(spark, sf, "chunk_records"), table(spark, sf, "size_limits"))


def p2_cover(spark, sf):
    """Per chunk: its length, the chars its pieces cover without overlaps, and its overlap; equal to what SQL reads off the text."""
    chunks, limits = table(spark, sf, "chunk_records"), table(spark, sf, "size_limits")
    p = splitting.with_limits(splitting.split_pieces(chunks, limits, keep=("chunk_strategy",)), limits)
    own = F.when(F.col("piece_no") == 0, F.col("piece_chars")).otherwise(F.col("piece_chars") - F.col("overlap_chars"))
    return p.groupBy("chunk_id").agg(F.sum(own).alias("n_chars"), F.max(F.col("piece_chars") > F.col("max_chars")).alias("too_long"))


def p4_found(spark, sf):
    return scannoise.damage(table(spark, sf, "page_blocks"), table(spark, sf, "doc_pages"))


def p4_repaired(spark, sf):
    return scannoise.repaired(table(spark, sf, "page_blocks"), table(spark, sf, "doc_pages"))


def p5_found(spark, sf):
    return encoding.repaired(table(spark, sf, "page_blocks")).select("block_id").distinct()


def p5_restored(spark, sf):
    return encoding.repaired(table(spark, sf, "page_blocks")).dropDuplicates(["block_id"])


def p6_found(spark, sf):
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_cases")).select("doc_id", "case_id")


def p6_report(spark, sf):
    return leakage.leak_report(table(spark, sf, "documents"), table(spark, sf, "eval_cases"))


def p7_mix(spark, sf):
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_shares(spark, sf):
    return mixing.mix_shares(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))


def p7_short(spark, sf):
    """Shares of a mix three times as large as the targets allow: sources that run out hand over to the others."""
    return mixing.mix_shares(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), stretch=3.0)


def p7_char_shares(spark, sf):
    """The mix sized in chars, so that SQL can check it: what each source has, the share it should get, whether it gets that (but for whole chars), and whether its texts repeat too often."""
    docs, targets = table(spark, sf, "documents"), table(spark, sf, "mix_targets")
    have = mixing.distinct_texts(docs, targets, None).groupBy("source").agg(F.sum("n_tokens").alias("available"))
    s = mixing.mix_shares(docs, targets, path=None).join(have, "source")
    wanted = F.col("target_share") / F.sum("target_share").over(Window.partitionBy())  # a row per listed source
    s = s.withColumn("wanted_share", F.round(wanted, 6))
    return s.select("source", "available", "wanted_share", (F.abs(F.col("actual_share") - F.col("wanted_share")) <= 1e-4).alias("reached"), (F.col("most_uses") > F.col("max_repeats")).alias("too_often"))


def p8_found(spark, sf):
    return truncation.truncated(table(spark, sf, "documents")).select("doc_id")


def p8_rates(spark, sf):
    return truncation.truncation_rates(table(spark, sf, "documents"))


def p8_histogram(spark, sf):
    return truncation.length_histogram(table(spark, sf, "documents"))


def p8_limits(spark, sf):
    return truncation.unexplained_lengths(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_statistics, p1_plain, p1_scores, p1_plain_scores, p2_found, p2_pieces, p2_cover, p2_files, p4_found, p4_repaired, p5_found, p5_restored, p6_found, p6_report, p7_mix, p7_shares, p7_short, p7_char_shares, p8_found, p8_rates, p8_histogram, p8_limits)}

ORACLES = {
    "p1_plain": r"""select distinct block_id, length(text)::int as n_chars, len(regexp_extract_all(text, '[^ \t\n\r]+'))::int as n_words, len(regexp_extract_all(text, '[0-9]'))::int as n_digits,
      len(regexp_extract_all(text, '[.!?;:,](\n|$)'))::int as n_punctuated_lines from page_blocks where text is not null""",
    "p1_plain_scores": r"""with b as (select distinct block_id, text t from page_blocks where length(text) >= 80),
      s as (select block_id, case when regexp_matches(t, '[а-яії]') then 'uk' else 'latin' end lang, least(1000, 1000 * len(regexp_extract_all(t, '[0-9]')) // length(t))::int v0, least(1000, 1000 * len(regexp_extract_all(t, '[ \t\n\r]')) // length(t))::int v1,
        1000 - least(1000, 1000 * len(regexp_extract_all(t, '[.!?;:,](\n|$)')) // (length(t) - length(replace(t, chr(10), '')) + 1))::int v2 from b),
      l as (select block_id, lang, 0 stat, v0 v from s union all select block_id, lang, 1, v1 from s union all select block_id, lang, 2, v2 from s),
      c as (select lang, stat, v, count(*) n from l group by all),
      o as (select lang, stat, v, sum(n) over (partition by lang, stat order by v desc) up, sum(n) over (partition by lang, stat) ng from c),
      q as (select stat, v, sum(n) over (partition by stat order by v desc)::double / sum(n) over (partition by stat) pool from (select stat, v, sum(n) n from c group by all)),
      t as (select lang, stat, v, -ln((up + 200 * pool) / (ng + 200)) nlog from o join q using (stat, v))
      select block_id, lang, round(sum(v / 1000.0::double * nlog), 6) outlier_score from l join t using (lang, stat, v) group by 1, 2""",
    "p2_files": "select strategy, sum(n)::bigint n_chars, false too_long, false wrong_overlap from (select coalesce(chunk_strategy, 'default') strategy, chunk_id, max(length(text)) + 1 n from chunk_records where text is not null group by 1, 2) group by 1",
    "p2_found": f"""select distinct c.chunk_id from chunk_records c left join {_LIMITS} l on c.chunk_strategy = l.chunk_strategy
      where length(c.text) > coalesce(l.max_chars, (select min(max_chars) from size_limits where chunk_strategy = 'default'))""",
    "p2_cover": "select chunk_id, max(length(text))::bigint as n_chars, false as too_long from chunk_records where text is not null group by 1",
    "p7_char_shares": """with d as (select lower(trim(source)) source, text, doc_id from documents where text is not null and length(text) > 0 and lower(trim(source)) in (select lower(trim(source)) from mix_targets where target_share > 0)),
      o as (select text, arg_min(source, doc_id) source from d group by 1), g as (select source, sum(length(text))::bigint available from o group by 1),
      s as (select lower(trim(source)) source, sum(target_share) share from mix_targets group by 1)
      select source, available, round(share / (select sum(share) from s join g using (source)), 6)::double wanted_share, true reached, false too_often from g join s using (source)""",
    "p8_histogram": """select source, measure, length, count(*) as n from (
      select lower(trim(source)) as source, 'chars' as measure, length(text)::int as length from documents where text is not null and source is not null
      union all select lower(trim(source)), 'bytes', strlen(text)::int from documents where text is not null and source is not null) group by 1, 2, 3""",
}
