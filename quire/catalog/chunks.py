"""Queries over chunks."""

from pyspark.sql import functions as F

from quire.catalog import sql as S
from quire.catalog.sections import _SEG, _segmented
from quire.operators import chunks as C
from quire.operators import tables
from quire.queries import query
from quire.session import table

_PARAS = rf"""paras as (select chunk_id, (i - 1)::int para_no, {S.squeezed("ps[i]")} para from (select chunk_id, ps, unnest(range(1, len(ps) + 1)) i from (select chunk_id, string_split_regex(text, '\r?\n[ \t]*\r?\n') ps from chunks where text is not null)) where {S.squeezed("ps[i]")} <> '')"""


def _chunks(spark, sf):
    return tables.chunks(table(spark, sf, "chunk_records"))


def _written(spark, sf):
    """Chunks as written; rewrites are equal but for the time, so operators on single rows run in the scan and equal results go after."""
    return table(spark, sf, "chunk_records")


@query("c1_paragraphs", f"with {S.CHUNKS}, {_PARAS} select * from paras")
def c1(spark, sf):
    return C.paragraphs(_written(spark, sf)).distinct()


@query("c2_noise_paragraphs", rf"with {S.CHUNKS}, {_PARAS} select chunk_id, para_no from paras where regexp_matches(para, '^[0-9\s.,/-]+$') or regexp_matches(para, '(?:\. ?){{4,}}') or regexp_matches(para, '^(?:[Pp]age|p\.)\s*[0-9]+') or length(para) < 12")
def c2(spark, sf):
    return C.paragraphs(_written(spark, sf)).where(C.is_noise_paragraph(F.col("para"))).select("chunk_id", "para_no").distinct()


@query("c3_garbled_paragraphs", rf"with {S.CHUNKS}, {_PARAS}, t as (select chunk_id, para_no, string_split(para, ' ') w from paras) select chunk_id, para_no from t where len(w) >= 4 and len(list_filter(w, lambda x: length(x) = 1)) * 2 >= len(w)")
def c3(spark, sf):
    return C.paragraphs(_written(spark, sf)).where(C.is_garbled(F.col("para"))).select("chunk_id", "para_no").distinct()


@query("c4_packed_segments")
def c4(spark, sf):
    return _chunks(spark, sf).where("text is not null").select("chunk_id", F.posexplode(C.packed_sentences(F.col("text"))).alias("segment_no", "segment"))


@query("c7_structured_rows", f"""with {S.CHUNKS}, l as (select chunk_id, i - 1 line_no, list_transform(string_split(ls[i], ';'), lambda p: trim(p)) parts from (select chunk_id, ls, unnest(range(1, len(ls) + 1)) i from (select chunk_id, {S.lines("text")} ls from chunks where text is not null)))
  select chunk_id, line_no::int line_no, (j - 1)::int row_no, parts[j] as "row" from (select *, unnest(range(1, len(parts) + 1)) j from l where len(parts) >= 3) where parts[j] <> ''""")
def c7(spark, sf):
    return C.structured_rows(_written(spark, sf)).distinct()


_HINTS = S.labels([(h, "(" + " or ".join(f"contains(lower(text), '{c}')" for c in cues) + ")") for h, cues in C.HINTS])


@query("c10_semantics", rf"""with {S.CHUNKS}, t as (select chunk_id, text, regexp_extract_all(lower(text), '[a-z]{{4,}}') w from chunks where text is not null),
  u as (select chunk_id, w[i] term, i from (select chunk_id, w, unnest(range(1, len(w) + 1)) i from t)), f as (select chunk_id, term, min(i) i from u where not list_contains({S.STOP}, term) group by 1, 2),
  r as (select chunk_id, list(term order by i) terms from (select *, row_number() over (partition by chunk_id order by i) rn from f) where rn <= 14 group by 1)
  select t.chunk_id, coalesce(r.terms, []) terms, {_HINTS} hints from t left join r on t.chunk_id = r.chunk_id""")
def c10(spark, sf):
    return C.semantics(_written(spark, sf)).dropDuplicates(["chunk_id"])


@query("c11_size_packing")
def c11(spark, sf):
    return C.size_packed(tables.blocks(table(spark, sf, "page_blocks")))


@query("c12_chunk_assembly", f"""with {_SEG} select b.doc_id, s.section_no, min(b.page_num) + 1 page_start, max(b.page_num) + 1 page_end, min(bbox[1]) x0, min(bbox[2]) y0, max(bbox[3]) x1, max(bbox[4]) y1,
  case when count(distinct extraction_method) > 1 then 'mixed' else max(extraction_method) end as method, round(avg(text_quality_score), 9) mean_score, sum(token_count)::bigint tokens from seg s join blocks b on s.block_id = b.block_id group by 1, 2""")
def c12(spark, sf):
    return C.assembled(tables.blocks(table(spark, sf, "page_blocks")), _segmented(spark, sf))


@query("c13_links", f"with {S.CHUNKS} select chunk_id, lag(chunk_id) over w preceding_id, lead(chunk_id) over w following_id from chunks window w as (partition by doc_id order by page_start nulls first, reading_order_index nulls first, chunk_id)")
def c13(spark, sf):
    return C.links(C.numbered(_chunks(spark, sf)))


_LOW = f"lower({S.squeezed('text')})"
_C16 = S.labels(
    [("bare_number", "regexp_matches(low, '^[0-9]+$')"), ("contents_list", S.any_of("low", C.CONTENTS)), ("dotted_leader", r"regexp_matches(text, '\.\s*\.\s*\.\s*\.')"), ("imprint", S.any_of("low", C.IMPRINT)),
     ("name_only", "length(low) < 120 and not contains(text, '.') and not contains(text, ':') and low <> '' and cap >= 0.7 * len(w)"), ("statistics_jargon", S.any_of("low", C.JARGON)), ("too_short", "length(low) < 25")]
)


@query("c16_chunk_quality", rf"""with {S.CHUNKS}, a as (select chunk_id, text, {_LOW} low, list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '') w from chunks where text is not null),
  b as (select *, len(list_filter(w, lambda x: substr(x, 1, 1) = upper(substr(x, 1, 1)) and substr(x, 1, 1) <> lower(substr(x, 1, 1)))) cap from a), c as (select chunk_id, {_C16} noise_labels from b)
  select chunk_id, noise_labels, greatest(0, least(1, round(1.0 - coalesce(list_sum(list_transform(noise_labels, lambda l: (map {dict(C.NOISE)})[l])), 0), 6)))::double quality from c""")
def c16(spark, sf):
    return C.quality(_written(spark, sf)).dropDuplicates(["chunk_id"])
