"""Statuses and summaries over evaluation results and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import metrics


def case_results(cases: DataFrame, hits: DataFrame, relevant: DataFrame, answered: DataFrame, abstentions: DataFrame, k: int = 5) -> DataFrame:
    """case_id, negative, abstained, reciprocal_rank, recall, coverage: what ``case_status`` and ``suite_summary`` judge.

    ``hits`` (case_id, item, rank) against ``relevant`` (case_id, item); coverage is that of the
    answer (case_id, answer). A case without hits, relevant items or an answer counts as 0.
    """
    c = cases.join(answered.select("case_id", "answer"), "case_id", "left")
    r = metrics.ranking_metrics(hits, relevant, "case_id", k).select("case_id", "recall", "reciprocal_rank")
    j = cases.select("case_id", F.col("passage").isNull().alias("negative")).join(abstentions.select("case_id", F.col("abstain").alias("abstained")), "case_id", "left")
    return j.join(metrics.keyword_coverage(c, "answer").drop("matched"), "case_id").join(r, "case_id", "left").na.fill(0.0, ["recall", "reciprocal_rank"])


def case_status(results: DataFrame) -> DataFrame:
    """case_id, status of results (case_id, negative, abstained, reciprocal_rank, recall, coverage); nulls count as 0 or false."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ab = F.coalesce("abstained", F.lit(False))
    rules = [("pass", F.col("negative") & ab), ("negative_fail", F.col("negative")), ("fail", ab), ("retrieval_warning", (z("reciprocal_rank") < 1) | (z("recall") < 1)), ("answer_warning", z("coverage") < 1)]
    return results.select("case_id", T.first_label(rules, "pass").alias("status"))


def suite_summary(results: DataFrame, status: DataFrame) -> DataFrame:
    """One row: macro averages over the positive cases, success of negative ones, cases with a warning."""
    r = results.join(status, "case_id")
    pos = ~F.col("negative")
    m = lambda c: F.round(F.avg(F.when(pos, F.coalesce(F.col(c), F.lit(0.0)))), 6)
    return r.agg(F.count(F.lit(1)).alias("n_cases"), m("recall").alias("mean_recall"), m("reciprocal_rank").alias("mrr"), m("coverage").alias("mean_coverage"), F.count_if("negative").alias("n_negative"), F.count_if(pos & (F.col("status") != "pass")).alias("n_warnings"))


def processing_flags(heads: DataFrame, pages: DataFrame, inspected: DataFrame) -> DataFrame:
    """doc_id, flags, status: what stands out in the processing of a PDF; ``review`` from two flags, ``warn`` from one."""
    p = pages.select("doc_id", "page_num", "char_count", "ocr_used", "extraction_engine_disagreement").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("ocr_used").alias("ocr"), F.count_if("extraction_engine_disagreement").alias("dis"), F.count_if(F.col("char_count") < 40).alias("thin"))
    i = inspected.select("doc_id", F.col("status").alias("st"), F.col("has_encoding_issues").alias("enc")).dropDuplicates(["doc_id"])
    j = heads.select("doc_id", "title", "structure_confidence").join(p, "doc_id", "left").join(i, "doc_id", "left")
    t = lambda c: F.coalesce(c, F.lit(False))
    f = T.labels([("no_title", F.col("title").isNull()), ("weak_structure", t(F.col("structure_confidence") < 0.5)), ("mostly_ocr", t(F.col("ocr") * 2 > F.col("n"))), ("engines_differ", t(F.col("dis") > 0)), ("thin_pages", t(F.col("thin") > 0)), ("encoding", t(F.col("enc"))), ("not_inspected", F.col("st").isNull())])
    return j.select("doc_id", f.alias("flags"), T.first_label([("review", F.size(f) >= 2), ("warn", F.size(f) == 1)], "pass").alias("status"))


def support_ratio(aligned: DataFrame, key: str) -> DataFrame:
    """key, ratio, verdict: the share of claims that evidence supports, against 0.67."""
    g = aligned.groupBy(key).agg(F.round(F.avg(F.col("status").isin("exact", "fragment").cast("int")), 6).alias("ratio"))
    return g.select(key, "ratio", F.when(F.col("ratio") >= 0.67, "pass").otherwise("fail").alias("verdict"))


def layer_summary(layers: DataFrame) -> DataFrame:
    """layer, n, mean, all_pass of (layer, value, threshold) figures; a null value fails."""
    ok = F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False))
    return layers.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min(ok).alias("all_pass"))


def upload_rejections(files: DataFrame, most_bytes: int = 100 << 20, most_pages: int = 500) -> DataFrame:
    """name, reason: files that are no PDF, too large or too long (name, head, length, page_count)."""
    r = T.first_label([("not_pdf", ~F.coalesce(F.col("head").startswith("%PDF-"), F.lit(False))), ("too_large", F.col("length") > most_bytes), ("too_many_pages", F.col("page_count") > most_pages)])
    return files.select("name", r.alias("reason")).where("reason is not null")
