"""What stands inside chunks and pages: headers, inline headings, labels and sections, subtopics, slides, places of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunks as C

#: Labels of this library that open a part inside a text when a colon follows.
INLINE_HEADINGS = ("Name", "Office", "Parcel", "Category", "Remarks", "Signature", "Nombre", "Fecha", "Nom", "Bemerkung", "Summary", "Background", "Results")
#: (subtopic, words) of this library.
SUBTOPICS = (
    ("equipment", ("pump", "valve", "cable", "boiler", "harness", "gasket")), ("hearing", ("court", "witness", "appeal", "judgment", "exhibit")), ("lesson", ("pupil", "teacher", "quiz", "chapter", "syllabus")),
    ("care", ("clinic", "nurse", "dose", "symptom", "patient")), ("survey", ("median", "household", "sample", "panel", "enumerator")), ("permit", ("permit", "licence", "register", "parcel", "counter")),
)


def is_header(line: Column) -> Column:
    """Whether a squeezed line is probably a header: short, without a sentence end, in capitals or mostly in title case."""
    w = F.split(line, " ")
    titled = F.size(F.filter(w, lambda x: (F.left(x, F.lit(1)) == F.upper(F.left(x, F.lit(1)))) & (F.left(x, F.lit(1)) != F.lower(F.left(x, F.lit(1))))))
    caps = (line == F.upper(line)) & (line != F.lower(line))
    return (line != "") & (F.length(line) <= 120) & (F.size(w) <= 12) & ~line.rlike(r"[.?!]$") & (caps | (titled >= 0.7 * F.size(w)))


def header_lines(chunks: DataFrame) -> DataFrame:
    """chunk_id, line_no, line: the lines of each chunk that are probable headers."""
    x = chunks.where("text is not null").select("chunk_id", F.posexplode(F.transform(T.lines(F.col("text")), T.squeezed)).alias("line_no", "line"))
    return x.where(is_header(F.col("line")))


def inline_label(text: Column) -> Column:
    """The label of at most six words, nearly all in capitals, that a text opens with before a colon; null without one."""
    label = F.regexp_extract(text, r"^([A-Z0-9][A-Za-z0-9 /-]{1,60}):\s", 1)
    w = F.split(label, " ")
    caps = F.size(F.filter(w, lambda x: x == F.upper(x)))
    return F.when((label != "") & (F.size(w) <= 6) & (caps >= 0.8 * F.size(w)), label)


def inline_segments(chunks: DataFrame) -> DataFrame:
    """chunk_id, segment_no, heading, body: texts cut where an inline heading opens a part; what precedes the first has a null heading, empty bodies stay."""
    marked = F.regexp_replace(T.squeezed(F.col("text")), r"(^|[^A-Za-z])(" + "|".join(INLINE_HEADINGS) + r"): ?", "$1\x01$2\x02")
    x = chunks.where("text is not null").select("chunk_id", F.posexplode(F.split(marked, "\x01")).alias("segment_no", "s"))
    headed = F.col("s").contains("\x02")
    x = x.select("chunk_id", "segment_no", F.when(headed, F.substring_index("s", "\x02", 1)).alias("heading"), F.trim(F.when(headed, F.substring_index("s", "\x02", -1)).otherwise(F.col("s"))).alias("body"))
    return x.where("heading is not null or body <> ''")


def inline_sections(chunks: DataFrame) -> DataFrame:
    """chunk_id, para_no, section, path, kind: the last header seen in the chunk, below the chunk's own path, for each of its paragraphs.

    A paragraph that is a header opens a section; a chunk's paragraphs are few, so the window is small.
    """
    p = C.paragraphs(chunks).withColumn("header", F.when(is_header(F.col("para")), F.col("para")))
    w = Window.partitionBy("chunk_id").orderBy("para_no").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("section", F.last("header", ignorenulls=True).over(w))
    j = p.join(chunks.select("chunk_id", F.coalesce("section_path", F.array().cast("array<string>")).alias("base")), "chunk_id")
    path = F.array_join(F.concat("base", F.when(F.col("section").isNotNull(), F.array("section")).otherwise(F.array().cast("array<string>"))), " > ")
    low = F.lower(F.coalesce("section", F.lit("")))
    kind = T.first_label([("appendix", low.contains("annex") | low.contains("appendix")), ("table_section", low.contains("table")), ("checklist_section", low.contains("checklist")), ("inherited", F.col("section").isNull())], "report_section")
    return j.select("chunk_id", "para_no", "section", path.alias("path"), kind.alias("kind"))


def subtopics(chunks: DataFrame) -> DataFrame:
    """chunk_id, subtopic, cues: the subtopic with most different words of its list in the chunk, and those words; of equals the first listed."""
    low = F.lower("text")
    found = F.array(*[F.struct(F.lit(-i).alias("place"), F.lit(name).alias("subtopic"), F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w)).alias("cues")) for i, (name, words) in enumerate(SUBTOPICS)])
    best = F.array_max(F.transform(found, lambda x: F.struct(F.size(x.cues).alias("n"), x.place.alias("place"), x.subtopic.alias("subtopic"), x.cues.alias("cues"))))
    return chunks.where("text is not null").select("chunk_id", best.alias("b")).where("b.n > 0").select("chunk_id", "b.subtopic", "b.cues")


def slide_roles(chunks: DataFrame) -> DataFrame:
    """chunk_id, role, n_bullets: the part a slide plays, by an ordered rule table over its lines."""
    lines = T.lines(F.col("text"))
    bullets = F.size(F.filter(lines, lambda x: x.rlike(r"^(?:[-*•]|\(?[0-9a-z]{1,2}[.)])\s")))
    s = chunks.where("chunk_strategy = 'presentation_slide' and text is not null").select("chunk_id", F.lower(F.element_at(F.concat(lines, F.array(F.lit(""))), 1)).alias("first"), F.size(lines).alias("n"), bullets.alias("n_bullets"))
    role = T.first_label([("title_slide", F.col("n") <= 2), ("agenda", T.any_of(F.col("first"), ("agenda", "contents", "index"))), ("summary", T.any_of(F.col("first"), ("summary", "review", "conclusion"))), ("list_slide", F.col("n_bullets") * 2 >= F.col("n"))], "content")
    return s.select("chunk_id", role.alias("role"), "n_bullets")


def table_places(blocks: DataFrame) -> DataFrame:
    """block_id, after_id, n_shared: each table block of a page with the other block that shares most of its words; the table goes after it.

    Blocks of a page meet on words of three letters and more; of equals the
    first in reading order wins, and a table that shares none goes to the end of
    its page (null). The unit is a page, so what meets is bounded by a page.
    """
    w = F.explode(F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0), lambda x: F.length(x) >= 3))).alias("word")
    b = blocks.where("text is not null and doc_id is not null and page_num is not null").select("block_id", "doc_id", "page_num", "reading_order_index", F.coalesce((F.col("block_kind") == "table_like") | (F.col("block_role") == "table_like"), F.lit(False)).alias("is_table"), "text")
    tables = b.where("is_table").select("block_id", "doc_id", "page_num", w)
    others = b.where("not is_table").select(F.col("block_id").alias("other"), "reading_order_index", "doc_id", "page_num", w)
    s = tables.join(others, ["doc_id", "page_num", "word"]).groupBy("block_id", "other", "reading_order_index").agg(F.count(F.lit(1)).alias("n"))
    best = s.groupBy("block_id").agg(F.min(F.struct(F.negative("n").alias("m"), F.coalesce("reading_order_index", F.lit(-1)).alias("r"), "other")).alias("b"))
    return b.where("is_table").select("block_id").join(best, "block_id", "left").select("block_id", F.col("b.other").alias("after_id"), F.coalesce(F.negative("b.m"), F.lit(0)).alias("n_shared"))


def overlapping_tables(blocks: DataFrame, least: float = 0.9) -> DataFrame:
    """doc_id, block_id, first_id: table blocks with an earlier one on their page whose different words cover ``least`` of the smaller set.

    Tables of a page meet on their words; only pairs that share words arise.
    """
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0))
    t = blocks.where(F.coalesce((F.col("block_kind") == "table_like") | (F.col("block_role") == "table_like"), F.lit(False)) & F.col("text").isNotNull()).select("doc_id", "page_num", "block_id", w.alias("ws")).select("doc_id", "page_num", "block_id", F.size("ws").alias("k"), F.explode("ws").alias("word"))
    o = t.select("doc_id", "page_num", "word", F.col("block_id").alias("first_id"), F.col("k").alias("k2"))
    s = t.join(o, ["doc_id", "page_num", "word"]).where("first_id < block_id").groupBy("doc_id", "block_id", "first_id", "k", "k2").agg(F.count(F.lit(1)).alias("n"))
    return s.where(F.col("n") >= least * F.least("k", "k2")).groupBy("doc_id", "block_id").agg(F.min("first_id").alias("first_id"))
