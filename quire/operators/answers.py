"""Answers: sentences, support, alignment of claims, abstention, strict JSON parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: Words that don't count as terms of a claim.
CLAIM_STOPWORDS = ("and", "are", "but", "for", "from", "has", "have", "into", "not", "the", "this", "that", "with")


def sentence_rows(chunks: DataFrame, least: int = 30) -> DataFrame:
    """chunk_id, sentence_no, sentence: sentences of at least ``least`` chars."""
    s = F.posexplode(T.sentences(F.col("text"))).alias("sentence_no", "sentence")
    return chunks.where("text is not null").select("chunk_id", s).where(F.length("sentence") >= least)


def scored_sentences(queries: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, sentence_no, sentence, matched, score: words shared with the query, less 1.5 over 320 chars; none shared scores 0."""
    s = hits.select("query_id", "chunk_id").join(sentence_rows(chunks), "chunk_id").join(queries, "query_id")
    s = s.withColumn("matched", F.array_intersect(T.query_terms(F.col("query")), T.words(F.col("sentence"), "[a-z]{2,}")))
    shared = F.size("matched")
    return s.select("query_id", "chunk_id", "sentence_no", "sentence", "matched", F.when(shared == 0, 0.0).otherwise(shared - F.when(F.length("sentence") > 320, 1.5).otherwise(0.0)).cast("double").alias("score"))


def selected_evidence(scored: DataFrame, most: int = 4, new_word: float = 0.9, used_chunk: float = 2.0) -> DataFrame:
    """query_id, pick, chunk_id, sentence_no, score: greedy choice that pays for query words not yet covered and charges for chunks already used.

    Each pick takes the sentence of the highest score + ``new_word`` a new word
    - ``used_chunk`` for a chunk that gave one before; of equals the first by
    chunk and place. Sentences that share nothing are never picked. A query's
    sentences are those of its few hits.
    """
    c = scored.where("score > 0").groupBy("query_id").agg(F.collect_list(F.struct("chunk_id", F.col("sentence_no").cast("int").alias("sentence_no"), "score", "matched")).alias("c"))
    start = F.expr("struct(cast(array() as array<struct<chunk_id:string,sentence_no:int,score:double>>) as picks, cast(array() as array<string>) as covered)")

    def step(acc: Column, _: Column) -> Column:
        left = F.filter("c", lambda x: ~F.exists(acc.picks, lambda p: (p.chunk_id == x.chunk_id) & (p.sentence_no == x.sentence_no)))
        used = lambda x: F.exists(acc.picks, lambda p: p.chunk_id == x.chunk_id)
        value = lambda x: F.round(x.score + new_word * F.size(F.array_except(x.matched, acc.covered)) - F.when(used(x), used_chunk).otherwise(0.0), 6)
        best = F.array_min(F.transform(left, lambda x: F.struct(F.negative(value(x)).alias("m"), x.chunk_id.alias("chunk_id"), x.sentence_no.alias("sentence_no"), x.score.alias("score"), x.matched.alias("matched"))))
        taken = F.struct(F.concat(acc.picks, F.array(F.struct(best.chunk_id.alias("chunk_id"), best.sentence_no.alias("sentence_no"), best.score.alias("score")))).alias("picks"), F.array_union(acc.covered, best.matched).alias("covered"))
        return F.when(F.size(left) > 0, taken).otherwise(acc)

    picks = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step, lambda acc: acc.picks)
    return c.select("query_id", F.posexplode(picks).alias("k", "p")).select("query_id", (F.col("k") + 1).alias("pick"), "p.chunk_id", "p.sentence_no", "p.score")


def abstentions(queries: DataFrame, evidence: DataFrame) -> DataFrame:
    """query_id, abstain, reason: no evidence at all, or none that scores 2 or more."""
    top = evidence.groupBy("query_id").agg(F.max("score").alias("top"))
    j = queries.select("query_id").distinct().join(top, "query_id", "left")
    reason = T.first_label([("no_evidence", F.col("top").isNull()), ("weak_evidence", F.col("top") < 2)])
    return j.select("query_id", reason.isNotNull().alias("abstain"), reason.alias("reason"))


def surface(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def aligned(claims: DataFrame, fragments: DataFrame, key: str) -> DataFrame:
    """key, claim_no, status, score: each claim against the fragments of its own answer.

    exact: the claim stands in a fragment; fragment: 0.72 of its words do; weak:
    0.4; else unsupported. A claim without fragments is unsupported with score 0.
    """
    terms = lambda c: F.array_except(F.array_distinct(F.regexp_extract_all(surface(c), F.lit("[a-z0-9]{3,}"), 0)), F.array(*map(F.lit, CLAIM_STOPWORDS)))
    c = claims.select(key, "claim_no", surface(F.col("claim")).alias("cs"), terms(F.col("claim")).alias("ct"))
    f = fragments.select(key, surface(F.col("fragment")).alias("fs"), terms(F.col("fragment")).alias("ft"))
    j = c.join(f, key, "left")
    overlap = F.round(F.size(F.array_intersect("ct", "ft")) / F.greatest(F.size("ct"), F.lit(1)), 3)
    exact = (F.col("cs") != "") & (F.col("fs") != "") & F.col("fs").contains(F.col("cs"))
    score = F.when(F.col("fs").isNull() | (F.col("cs") == "") | (F.col("fs") == "") | (F.size("ct") == 0), F.when(exact, 1.0).otherwise(0.0)).when(exact, 1.0).otherwise(overlap)
    level = F.when(F.coalesce(exact, F.lit(False)), 3).when(score >= 0.72, 2).when(score >= 0.4, 1).otherwise(0)
    b = j.groupBy(key, "claim_no").agg(F.max(F.struct(level.alias("l"), score.alias("s"))).alias("b"))
    return b.select(key, "claim_no", F.element_at(F.array(*map(F.lit, ("unsupported", "weak", "fragment", "exact"))), F.col("b.l") + 1).alias("status"), F.col("b.s").alias("score"))


def alignment_summary(al: DataFrame, key: str) -> DataFrame:
    """key, claims, supported, weak, unsupported, ratio, verdict."""
    g = al.groupBy(key).agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.col("status").isin("exact", "fragment")).alias("supported"), F.count_if(F.col("status") == "weak").alias("weak"), F.count_if(F.col("status") == "unsupported").alias("unsupported"))
    return g.select("*", F.round(F.col("supported") / F.col("claims"), 3).alias("ratio"), F.when(F.col("unsupported") == 0, "pass").otherwise("needs_review").alias("verdict"))


def parse_status(raw: Column) -> Column:
    """ok, empty_output, multiple_fenced_blocks, text_outside_fence, non_json_fence, invalid_json or json_not_object of a model's output."""
    clean = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?is)<think>.*?</think>", ""))
    fences = F.regexp_count(clean, F.lit("```"))
    lang = F.lower(F.regexp_extract(clean, r"^```([A-Za-z]*)", 1))
    body = F.when(fences > 0, F.regexp_extract(clean, r"(?s)^```[A-Za-z]*\s*(.*?)\s*```$", 1)).otherwise(clean)
    fenced = clean.rlike(r"(?s)^```.*```$")
    parsed = F.try_parse_json(body)
    return T.first_label([("empty_output", clean == ""), ("multiple_fenced_blocks", fences > 2), ("text_outside_fence", (fences > 0) & ~fenced), ("non_json_fence", (fences > 0) & ~lang.isin("", "json", "jsonc")), ("invalid_json", parsed.isNull()), ("json_not_object", ~body.rlike(r"^\s*\{"))], "ok")
