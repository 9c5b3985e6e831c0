"""Sectioning: headings, levels, segmentation, hierarchy, kinds and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.ranking import running_maxima, running_totals

_NUMBERED = r"^\d+(?:\.\d+){0,3}(?:[).:-]|\s)"


def is_heading(n: Column, in_toc: Column) -> Column:
    """Whether squeezed text looks like a structural heading."""
    w = F.split(n, " ")
    titled = F.size(F.filter(w, lambda x: (F.substring(x, 1, 1) == F.upper(F.substring(x, 1, 1))) & (F.substring(x, 1, 1) != F.lower(F.substring(x, 1, 1)))))
    caps = (n == F.upper(n)) & (n != F.lower(n))
    short = (F.size(w) <= 14) & ~n.rlike(r"[.?!]$")
    shaped = caps | n.rlike(_NUMBERED) | F.lower(n).rlike(r"^question\s+\d+\b") | ((titled / F.size(w) >= 0.75) & (F.length(n) <= 90))
    return (n != "") & (in_toc | F.lower(n).rlike(r"^(?:chapter|part|appendix|section)\b") | (short & shaped))


def heading_level(n: Column, in_toc: Column) -> Column:
    """1 to 4, or null where the text tells no level."""
    low = F.lower(n)
    dots = F.length(F.regexp_extract(n, r"^(\d+(?:\.\d+){0,3})", 1)) - F.length(F.replace(F.regexp_extract(n, r"^(\d+(?:\.\d+){0,3})", 1), F.lit("."), F.lit("")))
    caps = (n == F.upper(n)) & (n != F.lower(n))
    return F.when(n == "", None).when(in_toc | low.rlike(r"^(?:chapter|part|appendix)\b"), 1).when(low.rlike(r"^section\b"), 2).when(n.rlike(_NUMBERED), F.least(dots + 1, F.lit(4))).when(caps, 1)


def headings(blocks: DataFrame, heads: DataFrame) -> DataFrame:
    """block_id, doc_id, page_num, reading_order_index, is_heading, level, title of every block with a text."""
    toc = heads.select("doc_id", F.explode("toc").alias("e")).select("doc_id", F.lower(T.squeezed(F.col("e"))).alias("key")).distinct().withColumn("in_toc", F.lit(True))
    b = blocks.where("text is not null").select("block_id", "doc_id", "page_num", "reading_order_index", T.squeezed(F.col("text")).alias("n"))
    b = b.withColumn("key", F.when(F.length("n") <= 160, F.lower("n")))
    j = b.join(toc, ["doc_id", "key"], "left").withColumn("in_toc", F.coalesce("in_toc", F.lit(False)))
    h = is_heading(F.col("n"), F.col("in_toc"))
    return j.select("block_id", "doc_id", "page_num", "reading_order_index", h.alias("is_heading"), F.when(h, heading_level(F.col("n"), F.col("in_toc"))).cast("int").alias("level"), F.when(h, F.col("n")).alias("title"))


def segmented(heads: DataFrame) -> DataFrame:
    """The headings frame with section_no: a new section at each heading; what precedes the first is section 0.

    The running count spreads over range partitions, so a PDF with a tenth of all blocks is no one task.
    """
    x = heads.withColumn("_h", F.col("is_heading").cast("int"))
    return running_totals(x, ["doc_id"], ["page_num", "reading_order_index", "block_id"], "_h", "section_no").drop("_h")


def section_table(seg: DataFrame) -> DataFrame:
    """doc_id, section_no, title, level, page_start, page_end (1-based), n_blocks of every section."""
    return seg.groupBy("doc_id", "section_no").agg(F.max(F.when(F.col("is_heading"), F.col("title"))).alias("title"), F.max(F.when(F.col("is_heading"), F.col("level"))).alias("level"), (F.min("page_num") + 1).alias("page_start"), (F.max("page_num") + 1).alias("page_end"), F.count(F.lit(1)).alias("n_blocks"))


def parents(sections: DataFrame) -> DataFrame:
    """doc_id, section_no, parent_no: the nearest earlier section with a smaller level (null counts as 1).

    A section without a level has no parent. Levels are at most 4, so the last
    section of each smaller level is all that a row needs from the past.
    """
    eff = F.coalesce("level", F.lit(1))
    marked = sections.select("doc_id", "section_no", "level", *[F.when(eff == i, F.col("section_no")).alias(f"_n{i}") for i in (1, 2, 3)])
    m = running_maxima(marked, ["doc_id"], ["section_no"], {f"_last{i}": f"_n{i}" for i in (1, 2, 3)})
    one, two, three = (F.col(f"_last{i}") for i in (1, 2, 3))
    pick = F.when(F.col("level") == 2, one).when(F.col("level") == 3, F.greatest(one, two)).when(F.col("level") == 4, F.greatest(one, two, three))
    return m.select("doc_id", "section_no", pick.alias("parent_no"))


def paths(sections: DataFrame, up: DataFrame) -> DataFrame:
    """doc_id, section_no, path: titles from the root down to the section; levels bound the depth, so three joins do."""
    s = sections.select("doc_id", "section_no", F.coalesce("title", F.lit("")).alias("title")).join(up, ["doc_id", "section_no"])
    out = s.select("doc_id", "section_no", F.array("title").alias("path"), F.col("parent_no").alias("_up"))
    for _ in range(3):
        p = s.select("doc_id", F.col("section_no").alias("_up"), F.col("title").alias("_t"), F.col("parent_no").alias("_next"))
        out = out.join(p, ["doc_id", "_up"], "left").select("doc_id", "section_no", F.when(F.col("_t").isNotNull(), F.concat(F.array("_t"), "path")).otherwise(F.col("path")).alias("path"), F.col("_next").alias("_up"))
    return out.drop("_up")


def kinds(seg: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, section_no, section_kind, section_role from the title and the kinds and roles of the blocks."""
    j = seg.select("block_id", "doc_id", "section_no", "title", "is_heading").join(blocks.select("block_id", "block_kind", "block_role", F.regexp_count("text", F.lit(":")).alias("colons")), "block_id")
    has = lambda c, *v: F.max(F.coalesce(F.col(c).isin(*v), F.lit(False)))
    g = j.groupBy("doc_id", "section_no").agg(F.lower(F.max(F.when(F.col("is_heading"), F.col("title")))).alias("t"), has("block_kind", "table_like").alias("table"), has("block_role", "table_like").alias("rtable"), has("block_role", "form_field", "checklist_item", "key_value").alias("form"), has("block_role", "list_item").alias("lst"), F.sum("colons").alias("colons"), F.count(F.lit(1)).alias("n"))
    t = F.coalesce("t", F.lit(""))
    kind = T.first_label([("appendix", t.contains("appendix")), ("table_section", t.contains("table") | F.col("table")), ("questionnaire_section", t.rlike(r"^(?:question|section)\s+\d+\b")), ("checklist_section", t.contains("checklist")), ("intro_section", t.contains("introduction") | t.contains("background")), ("checklist_section", F.col("colons") >= 3)], "report_section")
    g = g.withColumn("section_kind", kind)
    k = F.col("section_kind")
    role = T.first_label([("table", (k == "table_section") | F.col("rtable")), ("form", k.isin("questionnaire_section", "checklist_section") | F.col("form")), ("list", F.col("lst")), ("appendix", k == "appendix"), ("heading_group", (F.col("n") <= 1) & (t != ""))], "prose")
    return g.select("doc_id", "section_no", "section_kind", role.alias("section_role"))


def confidence(sections: DataFrame, up: DataFrame, kind: DataFrame) -> DataFrame:
    """doc_id, n_sections, structure_confidence: mean section confidence with a bonus for hierarchy (6 decimals)."""
    j = sections.join(up, ["doc_id", "section_no"]).join(kind, ["doc_id", "section_no"])
    one = 0.4 + 0.15 * F.col("title").isNotNull().cast("int") + 0.15 * F.col("level").isNotNull().cast("int") + 0.1 * F.col("parent_no").isNotNull().cast("int") + 0.1 * (F.col("n_blocks") > 1).cast("int") + 0.05 * (F.col("section_role") != "prose").cast("int")
    g = j.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.avg(T.clamp(one)).alias("a"), F.max((F.coalesce("level", F.lit(0)) > 1).cast("int")).alias("deep"))
    return g.select("doc_id", "n_sections", T.clamp(F.round(F.col("a") * 0.65 + 0.08 * F.col("deep") + 0.2, 6)).alias("structure_confidence"))
