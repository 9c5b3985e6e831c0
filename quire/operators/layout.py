"""Tables and columns on pages: column counts, Markdown tables, duplicate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.blocks import _columns


def column_counts(blocks: DataFrame) -> DataFrame:
    """doc_id, page_num, n_columns: text columns of each page with boxes on all blocks; 1 for pages of one column."""
    b = blocks.select("doc_id", "page_num", F.size("bbox").alias("k"), *[F.element_at("bbox", i + 1).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])
    p = b.groupBy("doc_id", "page_num").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("page"), F.min(F.coalesce((F.col("k") == 4).cast("int"), F.lit(0))).alias("placed")).where("placed = 1")
    return p.select("doc_id", "page_num", F.greatest(F.size(_columns(F.col("page"))), F.lit(1)).alias("n_columns"))


def markdown_tables(chunks: DataFrame, least: int = 40) -> DataFrame:
    """chunk_id, table_no, table_text, n_rows: pipe tables (header, separator, rows) with at least ``least`` letters and digits."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^(\|[^\n]*\|[ \t]*\r?\n\|[-:| \t]+\|[ \t]*(?:\r?\n\|[^\n]*\|[ \t]*)+)"), 1)
    t = chunks.where("text is not null").select("chunk_id", F.posexplode(found).alias("table_no", "table_text"))
    return t.where(F.length(F.regexp_replace("table_text", r"[^A-Za-z0-9]", "")) >= least).select("chunk_id", "table_no", "table_text", (F.size(F.split("table_text", "\n")) - 2).alias("n_rows"))


def duplicate_tables(blocks: DataFrame) -> DataFrame:
    """doc_id, page_num, block_id, first_id: table blocks whose different words equal those of an earlier one on the page.

    Blocks meet on a hash of their sorted words, so no pairs within a page are formed.
    """
    t = blocks.where((F.col("block_kind") == "table_like") & F.col("text").isNotNull()).select("doc_id", "page_num", "block_id", F.sha2(F.array_join(F.array_sort(F.array_distinct(T.words(F.col("text"), "[a-z0-9]+"))), " "), 256).alias("sig"))
    g = t.groupBy("doc_id", "page_num", "sig").agg(F.min("block_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return t.join(g, ["doc_id", "page_num", "sig"]).where("block_id <> first_id").select("doc_id", "page_num", "block_id", "first_id")


def fused_pages(blocks: DataFrame, margin: float = 2.5) -> DataFrame:
    """doc_id, page_num, choice: which engine's text a page keeps.

    A page scores one point per 200 chars of text of an engine, times the mean
    score of its blocks. Tables and forms keep the native text; OCR wins only by
    ``margin``; pages with one engine keep it.
    """
    ocr = F.col("extraction_method").isin("ocr", "mixed")
    pts = F.length("text") / 200.0 * F.coalesce("text_quality_score", F.lit(0.5))
    g = blocks.where("text is not null and extraction_method is not null").groupBy("doc_id", "page_num").agg(F.sum(F.when(ocr, pts)).alias("o"), F.sum(F.when(~ocr, pts)).alias("n"), F.max(F.coalesce(F.col("block_role").isin("table_like", "form_field", "key_value"), F.lit(False))).alias("grid"))
    return g.select("doc_id", "page_num", T.first_label([("native", F.col("o").isNull()), ("ocr", F.col("n").isNull()), ("native", F.col("grid")), ("ocr", F.round(F.col("o") - F.col("n"), 6) >= margin)], "merged").alias("choice"))
