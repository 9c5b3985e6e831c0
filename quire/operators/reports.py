"""Reports over documents, pairs of documents, runs and the corpus: differences, second passes, statuses, gates and sanity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import semantics


def difference_summaries(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """first_doc, second_doc, summary: in what purpose, style, audience and family two documents differ; null where in nothing.

    A facet without a hint (``general``) differs from nothing.
    """
    f = semantics.facets(heads).groupBy("doc_id").pivot("facet", ["purpose", "style", "audience"]).agg(F.first("value")).join(semantics.families(heads), "doc_id")
    names = (("purpose", "purposes"), ("style", "evidence styles"), ("audience", "audiences"), ("family", "families"))
    one = lambda side: f.select(F.col("doc_id").alias(f"{side}_doc"), *[F.col(c).alias(f"{side}_{c}") for c, _ in names])
    j = pairs.select("first_doc", "second_doc").join(one("first"), "first_doc").join(one("second"), "second_doc")
    said = lambda c: F.replace(F.col(c), F.lit("_"), F.lit(" "))
    parts = F.filter(F.array(*[F.when((F.col(f"first_{c}") != F.col(f"second_{c}")) & ~F.col(f"first_{c}").isin("general", "other") & ~F.col(f"second_{c}").isin("general", "other"), F.concat(F.lit(f"their {n} differ ("), said(f"first_{c}"), F.lit(" vs "), said(f"second_{c}"), F.lit(")"))) for c, n in names]), lambda x: x.isNotNull())
    return j.withColumn("parts", parts).select("first_doc", "second_doc", F.when(F.size("parts") > 0, F.concat(F.lit("Both are relevant, but "), F.array_join("parts", " and "), F.lit("."))).alias("summary"))


def second_pass(heads: DataFrame, threshold: float = 0.62) -> DataFrame:
    """doc_id, first, second, accepted: documents of low confidence judged again with file name and type as further signals; a higher confidence is accepted."""
    more = heads.withColumn("title", F.concat_ws(" ", "title", "source_pdf", F.replace("document_type", F.lit("_"), F.lit(" "))))
    a = semantics.semantic_confidence(heads).select("doc_id", F.col("confidence").alias("first")).where(F.col("first") < threshold)
    b = semantics.semantic_confidence(more).select("doc_id", F.col("confidence").alias("second"))
    return a.join(b, "doc_id").select("doc_id", "first", "second", (F.col("second") > F.col("first")).alias("accepted"))


def labels(heads: DataFrame) -> DataFrame:
    """doc_id, title_quality (missing, opaque, long, good), label: the title where it is good, else words of the id without its number."""
    t = F.trim(F.coalesce("title", F.lit("")))
    q = T.first_label([("missing", t == ""), ("opaque", t.rlike(r"^[A-Za-z]*[-_ ]?\d{3,}$") | ~t.rlike(r"\p{L}{3}")), ("long", F.length(t) > 120)], "good")
    derived = F.trim(F.regexp_replace(F.regexp_replace("doc_id", r"-\d{4,}$", ""), "-", " "))
    return heads.select("doc_id", q.alias("title_quality"), F.when(q == "good", t).otherwise(derived).alias("label"))


def corpus_checks(diag: DataFrame, actions: DataFrame) -> DataFrame:
    """name, passed: whether the corpus report is complete: buckets, rates, an action each, and as many follow-ups as buckets beyond a limit."""
    d = diag.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("untitled_rate").isNull() | F.col("weak_rate").isNull()).alias("bad"), F.count_if((F.col("untitled_rate") > 0.2) | (F.col("weak_rate") > 0.3) | F.coalesce(F.col("mean_layout") < 0.5, F.lit(False))).alias("over"))
    a = actions.agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("action").isNull()).alias("none"), F.count_if(F.col("action") != "keep").alias("todo"))
    checks = F.array(*[F.struct(F.lit(n).alias("name"), c.alias("passed")) for n, c in (("buckets_present", F.col("n") > 0), ("rates_present", F.col("bad") == 0), ("an_action_each", (F.col("m") == F.col("n")) & (F.col("none") == 0)), ("follow_ups_match", F.col("todo") == F.col("over")))])
    return d.crossJoin(a).select(F.explode(checks).alias("c")).select("c.*")  # one row each


def contract_status(matched: DataFrame, primary: DataFrame, evidence: DataFrame) -> DataFrame:
    """run_key, n_matched, n_primary, n_evidence, from_matched, supported, status of runs; ``matched`` and ``primary``: run_key, value; ``evidence``: run_key.

    Primary documents must be among the matched ones, and a run that names one needs evidence; runs that name none are skipped.
    """
    docs = lambda df, n: df.where("value is not null").groupBy("run_key").agg(F.array_sort(F.collect_set("value")).alias(n))
    j = docs(matched, "a").join(docs(primary, "b"), "run_key", "full").join(evidence.groupBy("run_key").agg(F.count(F.lit(1)).alias("n_evidence")), "run_key", "full")
    none = F.array().cast("array<string>")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    j = j.select("run_key", F.size(a).alias("n_matched"), F.size(b).alias("n_primary"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), (F.size(F.array_except(b, a)) == 0).alias("from_matched"))
    j = j.withColumn("supported", F.col("n_evidence") > 0)
    return j.withColumn("status", T.first_label([("skip", F.col("n_primary") == 0), ("fail", ~F.col("from_matched")), ("warn", ~F.col("supported"))], "pass"))


#: What is said of each processing flag.
MESSAGES = {"no_title": "The document has no title.", "weak_structure": "Its structure is uncertain.", "mostly_ocr": "Most pages were read by OCR.", "engines_differ": "The engines disagree on a page.", "thin_pages": "A page has next to no text.", "encoding": "Its encoding may be wrong.", "not_inspected": "It was not inspected."}


def acceptance(flags: DataFrame) -> DataFrame:
    """doc_id, verdict (accept, accept_with_notes, needs_review), messages of processing flags (doc_id, flags, status)."""
    said = F.create_map(*[F.lit(x) for k, v in MESSAGES.items() for x in (k, v)])
    verdict = F.when(F.col("status") == "pass", "accept").when(F.col("status") == "warn", "accept_with_notes").otherwise("needs_review")
    return flags.select("doc_id", verdict.alias("verdict"), F.array_join(F.transform("flags", lambda x: F.element_at(said, x)), " ").alias("messages"))


def ui_status(heads: DataFrame, pages: DataFrame, inspected: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, flags, status (ready, review, incomplete) of each document for a display: OCR, encoding, engines, tables, index and confidences."""
    p = pages.distinct().groupBy("doc_id").agg(F.count_if("needs_ocr").alias("need"), F.count_if("ocr_used").alias("used"), F.count_if("extraction_engine_disagreement").alias("dis"))
    i = inspected.groupBy("doc_id").agg(F.max("has_encoding_issues").alias("enc"), F.max(F.coalesce(F.size("pages_with_tables"), F.lit(0))).alias("tab"))
    c = chunks.where("chunk_id is not null").groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("n"))
    j = heads.select("doc_id", "structure_confidence", "layout_confidence").join(p, "doc_id", "left").join(i, "doc_id", "left").join(c, "doc_id", "left")
    z, t = lambda x: F.coalesce(F.col(x), F.lit(0)), lambda x: F.coalesce(x, F.lit(False))
    f = T.labels([("ocr_used", (z("need") > 0) | (z("used") > 0)), ("encoding_uncertain", t(F.col("enc"))), ("engine_disagreement", z("dis") > 0), ("tables_detected", z("tab") > 0), ("not_indexed", z("n") == 0), ("structure_uncertain", t(F.col("structure_confidence") < 0.55)), ("layout_uncertain", t(F.col("layout_confidence") < 0.55)), ("ocr_incomplete", z("need") > z("used"))])
    doubts = F.array(*map(F.lit, ("encoding_uncertain", "engine_disagreement", "structure_uncertain", "layout_uncertain", "ocr_incomplete")))
    return j.withColumn("flags", f).select("doc_id", "flags", T.first_label([("incomplete", F.array_contains("flags", "not_indexed")), ("review", F.arrays_overlap("flags", doubts))], "ready").alias("status"))


def sanity(heads: DataFrame, pages: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, failed, all_pass: seven checks that a document went through all stages: pages, blocks, chunks, titles of sections, text, page ranges and links."""
    p = pages.groupBy("doc_id").agg(F.max("page_num").alias("last_page"))
    b = blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.length(F.trim("text")) > 0).alias("n_full"))
    c = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("section_title").alias("n_titled"), F.count_if(F.col("page_end") < F.col("page_start")).alias("n_back"), F.count_if((F.col("preceding_chunk_id") == F.col("chunk_id")) | (F.col("following_chunk_id") == F.col("chunk_id"))).alias("n_self"))
    j = heads.select("doc_id", "page_count").join(p, "doc_id", "left").join(b, "doc_id", "left").join(c, "doc_id", "left")
    z = lambda x: F.coalesce(F.col(x), F.lit(0))
    bad = [("pages", F.col("last_page").isNull()), ("page_count", F.coalesce(F.col("last_page") >= F.col("page_count"), F.lit(True))), ("blocks", z("n_blocks") == 0), ("text", z("n_full") * 2 < z("n_blocks")), ("chunks", z("n_chunks") == 0), ("section_titles", z("n_titled") == 0), ("ranges_and_links", z("n_back") + z("n_self") > 0)]
    return j.withColumn("failed", T.labels(bad)).select("doc_id", "failed", (F.size("failed") == 0).alias("all_pass"))


def gate_table(figures: DataFrame, gates: list[tuple[str, Column, float]]) -> DataFrame:
    """gate, value, threshold, status (pass, fail, skip without a value) of a release, and a last row ``release`` with the share of passed gates that aren't skipped."""
    one = figures.agg(*[F.round(v, 6).alias(n) for n, v, _ in gates])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).cast("double").alias("value"), F.lit(float(t)).alias("threshold")) for n, _, t in gates])).alias("g")).select("g.*")
    rows = rows.withColumn("status", T.first_label([("skip", F.col("value").isNull()), ("pass", F.col("value") >= F.col("threshold"))], "fail"))
    whole = rows.agg(F.round(F.count_if(F.col("status") == "pass") / F.nullif(F.count_if(F.col("status") != "skip"), F.lit(0)), 6).alias("value"), F.count_if(F.col("status") == "fail").alias("n_fail"))
    return rows.unionByName(whole.select(F.lit("release").alias("gate"), "value", F.lit(1.0).alias("threshold"), F.when(F.col("n_fail") == 0, "pass").otherwise("fail").alias("status")))
