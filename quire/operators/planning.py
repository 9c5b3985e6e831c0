"""Query planning: terms, cues, mode scores, intents, shortlists and retrieval contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: Cue words of this library by cue.
CUES = {
    "overview_cue": ("overview", "about", "summary", "cover"), "type_cue": ("what type", "what kind", "form"), "purpose_cue": ("purpose", "why"), "audience_cue": ("who", "audience"), "confidence_cue": ("confident", "certain", "sure"),
    "rationale_cue": ("because", "reason"), "routing_cue": ("which", "where"), "compare_cue": ("compare", "difference", "versus"), "justification_cue": ("justify", "support", "evidence"), "plural_source_cue": ("sources", "documents", "files", "list"),
}
#: (mode, cue, weight): additive scores.
MODE_RULES = (
    ("document_overview", "overview_cue", 4.0), ("document_overview", "type_cue", 4.5), ("document_overview", "purpose_cue", 4.5), ("document_overview", "audience_cue", 4.5), ("document_overview", "confidence_cue", 4.5), ("document_overview", "rationale_cue", 4.25),
    ("document_routing", "routing_cue", 4.0), ("source_justification", "justification_cue", 4.0), ("source_listing", "plural_source_cue", 4.0), ("cross_document_compare", "compare_cue", 4.0),
)
#: Fixed values: (multiplier, least pool) of the candidate pool by intent; others have DEFAULT_POOL.
POOLS = {"source_listing": (8, 30), "cross_document_compare": (8, 30), "document_overview": (6, 24), "document_routing": (8, 30), "source_justification": (8, 30), "definition": (4, 15)}
DEFAULT_POOL = (4, 15)
#: What an intent adds to a query.
EXPANSIONS = {"document_overview": "overview summary purpose", "document_routing": "document source", "source_listing": "sources documents", "definition": "defined as means", "source_justification": "evidence support", "cross_document_compare": "difference compared"}


def cues(queries: DataFrame) -> DataFrame:
    """query_id and one flag per cue."""
    low = F.lower(F.coalesce("query", F.lit("")))
    return queries.select("query_id", *[T.any_of(low, ws).alias(c) for c, ws in CUES.items()])


def mode_scores(flags: DataFrame) -> DataFrame:
    """query_id, mode, score: additive scores of every mode; grounded evidence starts at 0.5."""
    modes = ["grounded_evidence", *dict.fromkeys(m for m, _, _ in MODE_RULES)]
    score = lambda m: sum((F.col(c).cast("int") * w for mm, c, w in MODE_RULES if mm == m), F.lit(0.5 if m == "grounded_evidence" else 0.0))
    return flags.select("query_id", F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), score(m).cast("double").alias("score")) for m in modes])).alias("s")).select("query_id", "s.mode", "s.score")


def chosen_mode(scores: DataFrame) -> DataFrame:
    """query_id, mode, score: the best mode; of equal scores the name that sorts last."""
    return scores.groupBy("query_id").agg(F.max(F.struct("score", "mode")).alias("b")).select("query_id", "b.mode", "b.score")


def intent(query: Column) -> Column:
    """The first intent of an ordered rule table that holds, else ``generic``."""
    low = F.lower(F.coalesce(query, F.lit("")))
    return T.first_label([("definition", low.rlike(r"\b(?:define|definition|what is|meaning)\b")), ("cross_document_compare", T.any_of(low, CUES["compare_cue"])), ("source_listing", low.startswith("which")), ("document_routing", low.startswith("where")), ("source_justification", low.startswith("why")), ("document_overview", low.startswith("what") | low.startswith("how"))], "generic")


def contracts(queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, intent, path, pool_size, neighbor_depth, per_doc_limit."""
    q = queries.select("query_id", intent(F.col("query")).alias("intent"))
    i = F.col("intent")
    mult = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, v in POOLS.items() for x in (n, v[0])]), i), F.lit(DEFAULT_POOL[0]))
    least = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for n, v in POOLS.items() for x in (n, v[1])]), i), F.lit(DEFAULT_POOL[1]))
    path = T.first_label([("cross_document_discovery", i.isin("source_listing", "cross_document_compare", "document_routing", "source_justification")), ("document_understanding", i == "document_overview")], "single_document_qa")
    return q.select("query_id", "intent", path.alias("path"), F.greatest(mult * k, least).alias("pool_size"), F.when(i == "generic", 1).when(i == "definition", 0).otherwise(2).alias("neighbor_depth"), F.when(path == "cross_document_discovery", 1).otherwise(2).alias("per_doc_limit"))


def largest_pool(k: int = 5) -> int:
    """The largest pool that a contract gives."""
    return max(max(m * k, least) for m, least in (*POOLS.values(), DEFAULT_POOL))


def augmented(queries: DataFrame) -> DataFrame:
    """query_id, augmented: the query with what its intent adds."""
    add = F.element_at(F.create_map(*[F.lit(x) for n, v in EXPANSIONS.items() for x in (n, v)]), intent(F.col("query")))
    return queries.select("query_id", F.concat_ws(" ", F.col("query"), add).alias("augmented"))


def shortlist(queries: DataFrame, heads: DataFrame, limit: int = 6) -> DataFrame:
    """query_id, doc_id, score, matched, rank: documents for each query by overlap and rarity of title and contents words.

    Title words count 4, words of the table of contents 2.5; each shared word
    adds 4 / (documents that have it), and 6 when only one has it. Queries and
    documents meet on shared words only; the words of a query are few.
    """
    word = lambda c, w: F.transform(F.array_distinct(F.array_except(T.words(c, "[a-z]{3,}"), F.array(*map(F.lit, T.STOPWORDS)))), lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    toc = F.array_join(F.coalesce("toc", F.array().cast("array<string>")), " ")
    d = heads.select("doc_id", F.explode(F.concat(word(F.coalesce("title", F.lit("")), 4.0), word(toc, 2.5))).alias("x")).select("doc_id", "x.*").groupBy("doc_id", "term").agg(F.sum("w").alias("w"))
    df = d.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    q = queries.select("query_id", F.explode(T.query_terms(F.col("query"))).alias("term"))
    hit = q.join(df, "term").join(d, "term")
    s = hit.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") + 4.0 / F.col("df") + F.when(F.col("df") == 1, 6.0).otherwise(0.0)), 6).alias("score"), F.array_sort(F.collect_set("term")).alias("matched"))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return r.where(F.col("rank") <= limit).select("query_id", "doc_id", "score", "matched", "rank")


def anchors(queries: DataFrame, heads: DataFrame) -> DataFrame:
    """query_id, doc_id of documents whose whole title (12 chars or more) stands in a query.

    Titles and queries meet on the title's rarest-looking (longest) word, not by comparing all with all.
    """
    t = heads.where(F.length("title") >= 12).select("doc_id", F.lower("title").alias("title"))
    t = t.withColumn("term", F.array_max(F.transform(T.words(F.col("title"), "[a-z]{3,}"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).w)
    q = queries.select("query_id", F.lower("query").alias("q"), F.explode(F.array_distinct(T.words(F.col("query"), "[a-z]{3,}"))).alias("term"))
    return q.join(t, "term").where(F.col("q").contains(F.col("title"))).select("query_id", "doc_id").distinct()
