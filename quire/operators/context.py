"""Plans, sources and contexts of queries: which documents a query means, what is added to its hits, and what its answer says of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import planning, retrieval, semantics
from quire.session import cut_lineage

#: This library's own rules for forms: (form intent, words of a query).
FORM_INTENTS = (("form_field", ("parcel", "signature", "counter", "guardian")), ("table_lookup", ("table", "median", "figure", "estimate")), ("checklist_item", ("checklist", "tick", "screening")), ("exercise", ("quiz", "exercise", "worksheet", "rubric")))


def preferences(queries: DataFrame) -> DataFrame:
    """query_id, families, purposes that the words of a query speak for, sorted; by the hints of semantics.FACETS and the families these lead to."""
    low = F.lower(F.coalesce("query", F.lit("")))
    purposes = T.labels([(v, T.any_of(low, hints)) for f, v, _, hints in semantics.FACETS if f == "purpose"])
    hints = {(f, v): h for f, v, _, h in semantics.FACETS}
    words = [(name, [w for c, vs in by.items() for v in vs for w in hints.get((c, v), ())]) for name, by in semantics.FAMILIES]
    return queries.select("query_id", F.array_sort(T.labels([(n, T.any_of(low, ws)) for n, ws in words])).alias("families"), F.array_sort(purposes).alias("purposes"))


def form_intent(query: Column) -> Column:
    """The first form intent of FORM_INTENTS whose words a query holds; null without one."""
    words = T.words(F.coalesce(query, F.lit("")), "[a-z]+")
    return T.first_label([(n, F.arrays_overlap(words, F.array(*map(F.lit, ws)))) for n, ws in FORM_INTENTS])


def plans(queries: DataFrame, shortlisted: DataFrame) -> DataFrame:
    """query_id, class, intent, mode, doc_ids, fallback: the plan of each query over its shortlist (query_id, doc_id, rank).

    Overviews, routing, justifications and comparisons are document queries and
    name documents (1, 1, 1 and 3; listings 4); a comparison with fewer than two
    documents and a document query with none fall back to grounded evidence.
    """
    i = F.col("intent")
    docs = shortlisted.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x.doc_id).alias("ids"))
    q = queries.select("query_id", planning.intent(F.col("query")).alias("intent"), form_intent(F.col("query")).alias("form")).join(docs, "query_id", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    most = F.when(i.isin("document_overview", "document_routing", "source_justification"), 1).when(i == "cross_document_compare", 3).when(i == "source_listing", 4).otherwise(0)
    q = q.withColumn("doc_ids", F.slice(ids, F.lit(1), most))
    fallback = F.when(i == "cross_document_compare", F.size("doc_ids") < 2).otherwise((most > 0) & (F.size("doc_ids") == 0))
    klass = T.first_label([("document_query", (most > 0) & ~fallback), ("structured_form", F.col("form").isNotNull())], "evidence_lookup")
    q = q.withColumn("fallback", fallback).withColumn("class", klass)
    mode = F.when(F.col("class") == "document_query", i).when(F.col("class") == "structured_form", F.lit("structured_form")).otherwise("grounded_evidence")
    return q.select("query_id", "class", "intent", mode.alias("mode"), F.when(F.col("class") == "document_query", F.col("doc_ids")).otherwise(F.array().cast("array<string>")).alias("doc_ids"), "fallback")


def sources(plan: DataFrame, anchored: DataFrame) -> DataFrame:
    """query_id, preferred_doc, matching_docs: documents named in a query win over those of its plan; comparisons, listings and routing prefer none."""
    a = anchored.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("named"))
    j = plan.join(a, "query_id", "left")
    match = F.coalesce("named", "doc_ids")
    none = F.col("intent").isin("source_listing", "cross_document_compare", "document_routing")
    return j.select("query_id", F.when(~none & (F.size(match) > 0), F.element_at(match, 1)).alias("preferred_doc"), match.alias("matching_docs"))


def backfilled(ranked: DataFrame, queries: DataFrame, shortlisted: DataFrame, chunks: DataFrame, each: int = 2, k: int = 5) -> DataFrame:
    """query_id, doc_id, chunk_id, n_shared of the best ``each`` chunks of shortlisted documents that have none among a query's ``k`` best hits.

    Only chunks of those documents are looked at; they meet the query on doc_id
    and are counted by shared words, so no chunk meets a query it isn't listed for.
    """
    have = ranked.where(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    missing = shortlisted.select("query_id", "doc_id").distinct().join(have, ["query_id", "doc_id"], "left_anti")
    q = queries.select("query_id", T.query_terms(F.col("query")).alias("terms"))
    c = retrieval.admitted(chunks).where("text is not null").select("chunk_id", "doc_id", F.array_distinct(T.words(F.col("text"), "[a-z]{2,}")).alias("ws"))
    s = c.join(missing.join(q, "query_id"), "doc_id").select("query_id", "doc_id", "chunk_id", F.size(F.array_intersect("terms", "ws")).alias("n_shared")).where("n_shared > 0")
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("n_shared"), "chunk_id")))
    return r.where(F.col("r") <= each).select("query_id", "doc_id", "chunk_id", "n_shared")


def reranked_context(queries: DataFrame, hits: DataFrame, chunks: DataFrame, depth: int = 1) -> DataFrame:
    """query_id, chunk_id, hop, total, expanded_context_rank: hits (query_id, chunk_id) and their neighbours judged again together, without a prior for their first rank."""
    near = cut_lineage(retrieval.neighbours(hits.select("query_id", "chunk_id"), chunks, depth))
    s = retrieval.signals(near.select("query_id", "chunk_id", F.lit(0).alias("n_shared"), F.lit(1).alias("vector_rank")), queries, chunks)
    return s.join(near, ["query_id", "chunk_id"]).select("query_id", "chunk_id", "hop", "total", F.col("rank").alias("expanded_context_rank"))


def ranked_documents(shortlisted: DataFrame, ranked: DataFrame, prefs: DataFrame, families: DataFrame) -> DataFrame:
    """query_id, doc_id, score, place: shortlisted documents by shared words, the family a query speaks for, and their best hit.

    3 a shared word; 4 for a family asked for, -2.5 for another when one is asked for; 3 less 0.4 a rank (of 6 at most) for the best hit.
    """
    best = ranked.groupBy("query_id", "doc_id").agg(F.min("rank").alias("hit"))
    j = shortlisted.select("query_id", "doc_id", F.size("matched").alias("n")).join(best, ["query_id", "doc_id"], "left").join(prefs, "query_id", "left").join(families, "doc_id", "left")
    fam = F.when(F.coalesce(F.size("families"), F.lit(0)) <= 0, 0.0).when(F.coalesce(F.array_contains("families", F.col("family")), F.lit(False)), 4.0).otherwise(-2.5)
    hit = F.when(F.col("hit").isNull(), 0.0).otherwise(3.0 - 0.4 * F.least(F.col("hit") - 1, F.lit(6)))
    s = j.select("query_id", "doc_id", F.round(3.0 * F.col("n") + fam + hit, 6).alias("score"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def support_sentences(scored: DataFrame, chunks: DataFrame, each: int = 2) -> DataFrame:
    """query_id, doc_id, place, chunk_id, sentence_no, tier: the best ``each`` sentences of every document among a query's hits.

    Tier 1 shares words with the query; a document without such a sentence is supported by its first ones (tier 2).
    """
    s = scored.join(chunks.select("chunk_id", "doc_id"), "chunk_id").withColumn("tier", F.when(F.col("score") > 0, 1).otherwise(2))
    w = Window.partitionBy("query_id", "doc_id")
    s = s.withColumn("best", F.min("tier").over(w)).where("tier = best")
    r = s.withColumn("place", F.row_number().over(w.orderBy(F.desc("score"), "chunk_id", "sentence_no")))
    return r.where(F.col("place") <= each).select("query_id", "doc_id", "place", "chunk_id", "sentence_no", "tier")


def mode_answers(plan: DataFrame, heads: DataFrame) -> DataFrame:
    """query_id, mode, answer: what a document query's answer says of its documents (their titles in plan order); other queries have none."""
    t = heads.select("doc_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("doc_id")).alias("title"))
    d = plan.where("class = 'document_query'").select("query_id", "mode", F.posexplode("doc_ids").alias("pos", "doc_id")).join(t, "doc_id")
    g = d.groupBy("query_id", "mode").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x.title).alias("ts"))
    first, all_ = F.element_at("ts", 1), F.array_join("ts", "; ")
    text = F.when(F.col("mode") == "document_routing", F.concat(F.lit("See "), first, F.lit("."))).when(F.col("mode") == "source_justification", F.concat(F.lit("This rests on "), first, F.lit("."))).when(F.col("mode") == "document_overview", F.concat(F.lit("About "), first, F.lit("."))).when(F.col("mode") == "source_listing", F.concat(F.lit("Sources: "), all_, F.lit("."))).otherwise(F.concat(F.lit("Compared: "), all_, F.lit(".")))
    return g.select("query_id", "mode", text.alias("answer"))


def flattened(chunks: DataFrame, meaning: DataFrame) -> DataFrame:
    """chunk_id, section_path, content_hints, noise_labels, semantic_terms, chunk_text: chunk records with lists joined by ``|``; missing hints come from ``meaning`` (chunk_id, terms, hints)."""
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, "|"))
    j = chunks.join(meaning, "chunk_id", "left")
    return j.select("chunk_id", joined(F.col("section_path")).alias("section_path"), F.coalesce(joined(F.col("content_hints")), joined(F.col("hints"))).alias("content_hints"), joined(F.col("noise_labels")).alias("noise_labels"), joined(F.col("terms")).alias("semantic_terms"), F.col("text").alias("chunk_text"))
