"""Blocks to answers as one declarative plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import blocks as B
from quire.operators import chunks as C
from quire.operators import rendering, sections, tables


def structured(blocks: DataFrame, heads: DataFrame) -> dict[str, DataFrame]:
    """Classified blocks, sections with parents, paths, kinds and roles, and section chunks of raw blocks and document heads."""
    b, h = tables.blocks(blocks), tables.heads(heads)
    cls = B.classified(b)
    b = b.drop("block_kind", "block_role", "line_count", "token_count", "text_quality_score", "structural_flags").join(cls, "block_id")
    seg = sections.segmented(sections.headings(b, h))
    sec = sections.section_table(seg)
    up = sections.parents(sec)
    full = sec.join(up, ["doc_id", "section_no"]).join(sections.paths(sec, up), ["doc_id", "section_no"]).join(sections.kinds(seg, b), ["doc_id", "section_no"])
    return {"blocks": b, "sections": full, "chunks": C.assembled(b, seg)}


def answer_batch(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Answers of a batch of queries (query_id, query) over stored chunks; rewrites of a chunk count once."""
    return rendering.answered(queries.select("query_id", F.col("query")), tables.chunks(chunks), k)
