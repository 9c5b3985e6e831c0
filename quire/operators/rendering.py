"""From evidence to answers: support per document, dominant document, renderers, traces, end-to-end answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import answers, planning, retrieval, semantics
from quire.session import cut_lineage

#: Sentences an answer may have, by intent; others have 3.
BUDGETS = {"definition": 1, "document_overview": 4, "source_listing": 4, "cross_document_compare": 4}


def sentence_budget(intent: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in BUDGETS.items() for x in (k, v)]), intent), F.lit(3))


def dominant_docs(hits: DataFrame, key: str) -> DataFrame:
    """key, doc_id, n: the document with a strict majority of a key's hits, and at least two of them."""
    g = hits.groupBy(key, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("all", F.sum("n").over(Window.partitionBy(key))).where("n >= 2 and n * 2 > `all`").select(key, "doc_id", "n")


def label_fields(chunks: DataFrame) -> DataFrame:
    """chunk_id, field_no, label, value: ``label: value`` lines of a chunk."""
    pairs = F.filter(T.lines(F.col("text")), lambda x: x.rlike(r"^[^:=_.\n]{2,40}:\s+\S"))
    x = chunks.where("text is not null").select("chunk_id", F.posexplode(pairs).alias("field_no", "line"))
    return x.select("chunk_id", "field_no", F.trim(F.regexp_extract("line", r"^([^:]+):", 1)).alias("label"), F.trim(F.regexp_extract("line", r"^[^:]+:\s+(.*)$", 1)).alias("value"))


def snippets(hits: DataFrame, chunks: DataFrame, width: int = 240) -> DataFrame:
    """query_id, doc_id, snippet: of each query's best document, the beginnings of its three best chunks."""
    best = hits.groupBy("query_id").agg(F.min_by("doc_id", "rank").alias("doc_id"))
    h = hits.join(best, ["query_id", "doc_id"]).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("r <= 3")
    j = h.join(chunks.select("chunk_id", "text"), "chunk_id").select("query_id", "doc_id", "r", F.rtrim(F.substring(T.squeezed(F.col("text")), 1, width)).alias("s"))
    return j.groupBy("query_id", "doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda x: x.s), " … ").alias("snippet"))


def overviews(heads: DataFrame) -> DataFrame:
    """doc_id, overview: a sentence on each document, worded by how sure its classification is."""
    s = semantics.semantic_confidence(heads).select("doc_id", "label").join(semantics.families(heads), "doc_id").join(heads.select("doc_id", "title", "page_count"), "doc_id")
    verb = F.when(F.col("label") == "high", "is").when(F.col("label") == "medium", "looks like").otherwise("may be")
    return s.select("doc_id", F.concat_ws(" ", F.coalesce(F.col("title"), F.lit("This document")), verb, F.lit("a"), F.replace("family", F.lit("_"), F.lit(" ")), F.when(F.col("page_count").isNotNull(), F.concat(F.lit("of "), F.col("page_count").cast("string"), F.lit(" pages")))).alias("overview"))


def joined_evidence(evidence: DataFrame, scored: DataFrame) -> DataFrame:
    """query_id, answer, n_sentences, n_chunks: the picked sentences in pick order as one text."""
    e = evidence.join(scored.select("query_id", "chunk_id", "sentence_no", "sentence"), ["query_id", "chunk_id", "sentence_no"])
    g = e.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pick", "sentence"))), lambda x: x.sentence).alias("s"), F.count_distinct("chunk_id").alias("n_chunks"))
    return g.select("query_id", F.array_join("s", " ").alias("answer"), F.size("s").alias("n_sentences"), "n_chunks")


def answered(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """query_id, intent, answer, sources, abstained, trace (JSON): plan, retrieve, select, abstain or answer, for a batch of queries.

    Each query is searched with what its intent adds, in its contract's pool, with at most ``per_doc_limit`` hits of a document first and
    neighbours up to ``neighbor_depth`` hops. Every query has a row. A query whose evidence is missing or weak abstains with an empty answer.
    """
    contract = planning.contracts(queries, k)
    limits = contract.select("query_id", "per_doc_limit", "neighbor_depth")
    searched = planning.augmented(queries).withColumnRenamed("augmented", "query")
    ranked = retrieval.reranked(queries, chunks, planning.largest_pool(k), contract.select("query_id", "pool_size"), searched)
    hits = retrieval.diversified(ranked.join(limits, "query_id"), ["query_id"], k, F.col("per_doc_limit")).select("query_id", "neighbor_depth", "chunk_id")
    near = retrieval.neighbours(cut_lineage(hits), chunks).where("hop <= neighbor_depth")
    scored = cut_lineage(answers.scored_sentences(queries, near, chunks))
    ev = answers.selected_evidence(scored)
    ev = ev.join(contract.select("query_id", sentence_budget(F.col("intent")).alias("most")), "query_id").where("pick <= most").drop("most")
    text = joined_evidence(ev, scored)
    src = ev.join(chunks.select("chunk_id", "doc_id"), "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("sources"))
    j = contract.join(answers.abstentions(queries, ev), "query_id").join(text, "query_id", "left").join(src, "query_id", "left")
    none = F.array().cast("array<string>")
    trace = F.to_json(F.struct("path", "pool_size", "neighbor_depth", "per_doc_limit", "reason"))
    return j.select("query_id", "intent", F.when(F.col("abstain"), "").otherwise(F.col("answer")).alias("answer"), F.when(F.col("abstain"), none).otherwise(F.coalesce("sources", none)).alias("sources"), F.col("abstain").alias("abstained"), trace.alias("trace"))
