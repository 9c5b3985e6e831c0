"""Evaluation: ranking metrics, keyword coverage, slices, gates, sampling, diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def ranking_metrics(hits: DataFrame, relevant: DataFrame, key: str, k: int = 5) -> DataFrame:
    """key, precision, recall, reciprocal_rank of ranked hits (key, item, rank) against relevant items (key, item).

    Precision is over the number returned; the reciprocal rank looks at all hits. Keys without hits or without relevant items get 0.
    """
    rel = relevant.select(key, "item").distinct().withColumn("rel", F.lit(1))
    h = hits.join(rel, [key, "item"], "left").groupBy(key).agg(F.count_if(F.col("rank") <= k).alias("n"), F.sum(F.when(F.col("rank") <= k, F.coalesce("rel", F.lit(0))).otherwise(0)).alias("hit"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"))
    n_rel = rel.groupBy(key).agg(F.count(F.lit(1)).alias("n_rel"))
    j = h.join(n_rel, key, "full")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(key, z(F.when(F.col("n") > 0, F.round(F.col("hit") / F.col("n"), 6))).alias("precision"), z(F.when(F.col("n_rel") > 0, F.round(F.col("hit") / F.col("n_rel"), 6))).alias("recall"), z(F.round(1.0 / F.col("first"), 6)).alias("reciprocal_rank"))


def unique_docs(hits: DataFrame, key: str) -> DataFrame:
    """key, doc_id, doc_rank: documents in the order of their first hit."""
    f = hits.groupBy(key, "doc_id").agg(F.min("rank").alias("r"))
    return f.select(key, "doc_id", F.row_number().over(Window.partitionBy(key).orderBy("r", "doc_id")).alias("doc_rank"))


def keyword_coverage(cases: DataFrame, text: str = "passage") -> DataFrame:
    """case_id, matched, coverage: expected keywords in the text, also when blanks and signs are squeezed out; no keywords give 0."""
    fold = lambda c: F.lower(F.replace(F.replace(c, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")))
    packed = lambda c: F.regexp_replace(fold(c), r"[^\p{L}\p{N}]", "")
    t = F.coalesce(F.col(text), F.lit(""))
    kw = F.coalesce("expected_keywords", F.array().cast("array<string>"))
    hit = F.filter(kw, lambda k: fold(t).contains(fold(k)) | packed(t).contains(packed(k)))
    return cases.select("case_id", F.size(hit).alias("matched"), F.when(F.size(kw) > 0, F.round(F.size(hit) / F.size(kw), 6)).otherwise(0.0).alias("coverage"))


def keyword_relevance(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """case_id, item: the chunks that hold every word of a case's expected keywords, for cases without judged chunks.

    Cases and chunks meet on words, never all with all. A case without keywords has no relevant chunk.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0))
    k = cases.select("case_id", words(F.array_join("expected_keywords", " ")).alias("ws")).select("case_id", F.size("ws").alias("n"), F.explode("ws").alias("term"))
    c = chunks.where("text is not null").select(F.col("chunk_id").alias("item"), F.explode(words(F.col("text"))).alias("term"))
    return c.join(k, "term").groupBy("case_id", "item", "n").agg(F.count(F.lit(1)).alias("found")).where("found = n").select("case_id", "item")


def slices(cases: DataFrame, measures: DataFrame) -> DataFrame:
    """slice, n_cases, mean_coverage: a case counts in each of its slices (type, bucket, tags), once."""
    tags = F.transform(F.coalesce("case_tags", F.array().cast("array<string>")), lambda x: F.concat(F.lit("tag:"), x))
    own = F.array(F.concat(F.lit("type:"), "case_type"), F.concat(F.lit("bucket:"), "bucket"), F.when(F.col("passage").isNull(), F.lit("negative")))
    lab = cases.select("case_id", F.explode(F.array_distinct(F.filter(F.concat(own, tags), lambda x: x.isNotNull()))).alias("slice"))
    return lab.join(measures, "case_id").groupBy("slice").agg(F.count(F.lit(1)).alias("n_cases"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))


def gates(actual: DataFrame, thresholds: DataFrame) -> DataFrame:
    """name, threshold, actual, verdict: pass, fail, or missing where there is no figure; missing fails a gate."""
    j = thresholds.join(actual, "name", "left")
    return j.select("name", "threshold", "actual", T.first_label([("missing", F.col("actual").isNull()), ("pass", F.col("actual") >= F.col("threshold"))], "fail").alias("verdict"))


def latencies(rows: DataFrame, mode: str, value: str) -> DataFrame:
    """mode, n, mean, median, p95 (nearest rank) of a latency by mode; nulls are left out."""
    r = rows.where(F.col(value).isNotNull())
    w = Window.partitionBy(mode)
    rank = F.row_number().over(w.orderBy(value))
    x = r.groupBy(mode, value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(w.orderBy(value))
    x = x.withColumn("upto", upto).withColumn("n", F.sum("c").over(w))
    del rank
    p95 = x.where(F.col("upto") >= F.ceil(F.col("n") * 0.95)).groupBy(mode).agg(F.min(value).alias("p95"))
    g = r.groupBy(mode).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 3).alias("mean"), F.expr(f"percentile({value}, 0.5)").alias("median"))
    return g.alias("g").join(p95.alias("p"), F.col(f"g.{mode}").eqNullSafe(F.col(f"p.{mode}"))).select("g.*", "p.p95")


def corpus_bucket(text: Column, pages: Column) -> Column:
    """scan_like, form_like, short_doc, long_doc or medium_doc from names and page count."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return T.first_label([("scan_like", T.any_of(low, ("scan", "capture", "ocr"))), ("form_like", T.any_of(low, ("form", "statement", "application", "questionnaire", "checklist", "appendix"))), ("short_doc", pages <= 2), ("long_doc", pages >= 20)], "medium_doc")


def round_robin(entries: DataFrame, size: int, bucket: str = "bucket", order: tuple[str, ...] = ("page_count", "doc_id")) -> DataFrame:
    """The first ``size`` entries taking one of each bucket in turn, with round and place: a stratified sample without chance."""
    r = entries.withColumn("round", F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    r = r.where(F.col("round") <= size)  # a bucket gives no more than the sample
    return r.orderBy("round", bucket).limit(size)


def checksum(sample: DataFrame, column: str) -> DataFrame:
    """n, digest: SHA-256 over the sorted ids of a sample (bounded by its size)."""
    return sample.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(column)), "\n"), 256).alias("digest"))


def bucket_diagnostics(docs: DataFrame) -> DataFrame:
    """bucket, n_docs, structure rates and means (6 decimals; null where nothing is known)."""
    return docs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("structure_confidence"), 6).alias("mean_structure"), F.round(F.avg("layout_confidence"), 6).alias("mean_layout"), F.round(F.count_if(F.col("title").isNull()) / F.count(F.lit(1)), 6).alias("untitled_rate"), F.round(F.count_if(F.col("structure_confidence") < 0.5) / F.count(F.lit(1)), 6).alias("weak_rate"))


def follow_ups(diag: DataFrame) -> DataFrame:
    """bucket, action: the first rule by priority that a bucket's figures meet."""
    return diag.select("bucket", T.first_label([("review_titles", F.col("untitled_rate") > 0.2), ("review_structure", F.col("weak_rate") > 0.3), ("review_layout", F.col("mean_layout") < 0.5)], "keep").alias("action"))


def snapshot_delta(base: DataFrame, cand: DataFrame, key: str, metrics: list[str], higher_is_better: bool = True) -> DataFrame:
    """key, metric, base, candidate, delta, regressed: two snapshots unpivoted and compared; a missing side gives a null delta."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("x")).select(key, "x.*")

    j = long(base, "base").join(long(cand, "candidate"), [key, "metric"], "full")
    d = F.round(F.col("candidate") - F.col("base"), 6)
    return j.select(key, "metric", "base", "candidate", d.alias("delta"), F.coalesce(d < 0 if higher_is_better else d > 0, F.lit(False)).alias("regressed"))


def worst_of(checks: DataFrame, key: str) -> DataFrame:
    """key, status: the worst status of its checks, fail > review > warn > skip > pass."""
    sev = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(("pass", "skip", "warn", "review", "fail")) for x in (s, i)]), F.col("status"))
    return checks.groupBy(key).agg(F.max_by("status", sev).alias("status"))
