"""Document facets, families, resolution of stored over derived values, and relations between documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

#: Facet lexicons of this library: (facet, value, rank, hints); of equal counts the lower rank wins.
FACETS: tuple[tuple[str, str, int, tuple[str, ...]], ...] = (
    ("purpose", "registration_update", 0, ("registration", "register", "address", "appointment", "passport", "licence", "renewal")),
    ("purpose", "institutional_reporting", 1, ("report", "inspection", "review", "result", "record", "evidence")),
    ("purpose", "procedural_guidance", 2, ("manual", "handbook", "guidance", "protocol", "procedure", "checklist")),
    ("purpose", "statistical_reference", 3, ("table", "figure", "index", "frequency", "estimate", "survey")),
    ("audience", "clinicians", 0, ("patient", "nurse", "clinic", "dose", "fever", "triage", "vaccine")),
    ("audience", "legal_staff", 1, ("court", "tribunal", "docket", "appeal", "petition", "judgment", "witness")),
    ("audience", "learners", 2, ("lesson", "pupil", "teacher", "quiz", "exercise", "syllabus", "chapter")),
    ("audience", "engineers", 3, ("boiler", "pump", "valve", "cable", "gasket", "hoist", "generator", "torque")),
    ("style", "legal_record", 0, ("court", "statute", "injunction", "clause", "order")),
    ("style", "statistical_table", 1, ("survey", "median", "sample", "quartile", "panel", "forecast")),
    ("style", "structured_form", 2, ("form", "register", "receipt", "certificate", "declaration")),
)


def facet_counts(heads: DataFrame) -> DataFrame:
    """doc_id, facet, value, rank, n: hints of each facet value found in title and contents."""
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join(F.coalesce("toc", F.array().cast("array<string>")), " ")))
    one = lambda hints: sum((text.contains(h).cast("int") for h in hints), F.lit(0))
    rows = F.array(*[F.struct(F.lit(f).alias("facet"), F.lit(v).alias("value"), F.lit(r).alias("rank"), one(hints).alias("n")) for f, v, r, hints in FACETS])
    return heads.select("doc_id", F.explode(rows).alias("f")).select("doc_id", "f.*")


def facets(heads: DataFrame) -> DataFrame:
    """doc_id, facet, value, n: the best value of each facet, ``general`` without a hint."""
    best = facet_counts(heads).groupBy("doc_id", "facet").agg(F.max_by(F.struct("value", "n"), F.struct("n", F.negative("rank").alias("r"))).alias("b"))
    return best.select("doc_id", "facet", F.when(F.col("b.n") > 0, F.col("b.value")).otherwise("general").alias("value"), F.col("b.n").alias("n"))


def semantic_confidence(heads: DataFrame) -> DataFrame:
    """doc_id, confidence, label, warnings from the facets found and the title."""
    f = facets(heads).groupBy("doc_id").agg(F.count_if(F.col("value") != "general").alias("k"), F.sum("n").alias("n"))
    j = heads.select("doc_id", F.coalesce(F.length("title"), F.lit(0)).alias("len"), F.coalesce(F.size("toc"), F.lit(0)).alias("toc")).join(f, "doc_id")
    j = j.withColumn("c", T.clamp(F.round(0.35 + 0.15 * F.col("k") + 0.02 * F.least("n", F.lit(5)) + 0.1 * (F.col("toc") > 0).cast("int"), 6), 0.0, 0.95))
    label = T.first_label([("high", F.col("c") >= 0.8), ("medium", F.col("c") >= 0.62)], "low")
    return j.select("doc_id", F.col("c").alias("confidence"), label.alias("label"), T.labels([("no_title", F.col("len") == 0), ("no_facet", F.col("k") == 0), ("no_contents", F.col("toc") <= 0)]).alias("warnings"))


#: This library's own families: (family, {column: values}); the first row of which any column holds one of its values wins.
FAMILIES: tuple[tuple[str, dict[str, tuple[str, ...]]], ...] = (
    ("teaching", {"document_type": ("book",), "audience": ("learners",)}),
    ("court_and_law", {"document_type": ("court_opinion",), "style": ("legal_record",), "audience": ("legal_staff",)}),
    ("form", {"document_type": ("financial_statement", "assessment_form", "administrative_form", "registration_form"), "style": ("structured_form",), "purpose": ("registration_update",)}),
    ("figures", {"document_type": ("statistical_table", "model_report"), "style": ("statistical_table",), "purpose": ("statistical_reference",)}),
    ("report", {"document_type": ("inspection_report", "agency_report", "government_bulletin"), "purpose": ("institutional_reporting",)}),
    ("study", {"document_type": ("review_article", "empirical_study"), "audience": ("clinicians",)}),
    ("manual", {"document_type": ("technical_manual", "guidance_note"), "audience": ("engineers",), "purpose": ("procedural_guidance",)}),
)


def family_of(cols: dict[str, Column]) -> Column:
    """The family by FAMILIES of columns document_type, purpose, audience, style; ``other`` where no row holds."""
    rules = []
    for name, by in FAMILIES:
        holds = F.lit(False)
        for c, values in by.items():
            holds = holds | F.coalesce(cols[c].isin(*values), F.lit(False))
        rules.append((name, holds))
    return T.first_label(rules, "other")


def families(heads: DataFrame) -> DataFrame:
    """doc_id, family by the stored document type and the derived facets."""
    f = facets(heads).groupBy("doc_id").pivot("facet", ["purpose", "audience", "style"]).agg(F.first("value"))
    j = heads.select("doc_id", "document_type").join(f, "doc_id")
    return j.select("doc_id", family_of({c: F.col(c) for c in ("document_type", "purpose", "audience", "style")}).alias("family"))


def inventory_summaries(heads: DataFrame) -> DataFrame:
    """doc_id, coverage_terms (first spelling of each word of title and contents), inventory_summary."""
    words = F.slice(F.array_except(T.words(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.array_join(F.coalesce("toc", F.array().cast("array<string>")), " ")), "[a-z]{4,}"), F.array(*map(F.lit, T.STOPWORDS))), 1, 8)
    parts = F.array(F.col("title"), F.replace(F.nullif("document_type", F.lit("")), F.lit("_"), F.lit(" ")), F.concat(F.col("page_count").cast("string"), F.lit(" pages")))
    return heads.select("doc_id", words.alias("coverage_terms"), F.array_join(F.filter(parts, lambda x: x.isNotNull()), "; ").alias("inventory_summary"))


def resolved(heads: DataFrame) -> DataFrame:
    """doc_id, title, document_type: stored values over derived ones; a blank stored value counts as missing."""
    derived = F.initcap(F.regexp_replace(F.regexp_replace("doc_id", r"-\d{6,}$", ""), "-", " "))
    purpose = facets(heads).where("facet = 'purpose'").select("doc_id", F.col("value").alias("purpose"))
    j = heads.join(purpose, "doc_id")
    return j.select("doc_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), derived).alias("title"), F.coalesce(F.nullif(F.trim("document_type"), F.lit("")), F.col("purpose")).alias("document_type"))


def matched_pairs(runs_docs: DataFrame) -> DataFrame:
    """first_doc, second_doc, n_runs: documents that one run matched together. ``runs_docs``: parent_key, ordinal, value.

    A run matches a handful of documents, so the pairs within a run are few; no other pairs are formed.
    """
    a, b = runs_docs.select("parent_key", F.col("value").alias("first_doc")).distinct(), runs_docs.select("parent_key", F.col("value").alias("second_doc")).distinct()
    return a.join(b, "parent_key").where("first_doc < second_doc").groupBy("first_doc", "second_doc").agg(F.count(F.lit(1)).alias("n_runs"))


def relations(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """first_doc, second_doc, relation (overlap, complement, diverge), shared: by family, type and shared topical words."""
    d = families(heads).join(inventory_summaries(heads).select("doc_id", "coverage_terms"), "doc_id").join(heads.select("doc_id", F.coalesce("document_type", F.lit("")).alias("dt")), "doc_id")
    one = lambda side, p: d.select(F.col("doc_id").alias(f"{side}_doc"), F.col("family").alias(f"{p}f"), F.col("dt").alias(f"{p}t"), F.col("coverage_terms").alias(f"{p}c"))
    j = pairs.join(one("first", "a"), "first_doc").join(one("second", "b"), "second_doc")
    shared = F.array_sort(F.array_intersect("ac", "bc"))
    rel = T.first_label([("overlap", (F.col("af") == F.col("bf")) & (F.col("at") == F.col("bt")) & (F.size(shared) > 0)), ("complement", (F.col("at") == F.col("bt")) | (F.size(shared) > 0))], "diverge")
    return j.select("first_doc", "second_doc", rel.alias("relation"), F.slice(shared, 1, 3).alias("shared"))


def assessments(heads: DataFrame) -> DataFrame:
    """doc_id, confidence, trust: mean of what confidences there are, weighted 0.65 (semantic), 0.2 (structure), 0.15 (layout), at most 0.95."""
    s = semantic_confidence(heads).select("doc_id", F.col("confidence").alias("sem"))
    j = heads.select("doc_id", "structure_confidence", "layout_confidence").join(s, "doc_id")
    parts = [(F.col("sem"), 0.65), (F.col("structure_confidence"), 0.2), (F.col("layout_confidence"), 0.15)]
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    c = F.least(F.lit(0.95), F.round(total / weight, 6))
    return j.select("doc_id", c.alias("confidence"), T.first_label([("trusted", c >= 0.8), ("usable", c >= 0.62)], "verify").alias("trust"))
