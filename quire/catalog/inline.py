"""Queries over what stands inside chunks and pages."""

from pyspark.sql import functions as F

from quire.catalog import sql as S
from quire.catalog.chunks import _PARAS, _chunks, _written
from quire.operators import chunks as C
from quire.operators import inline, tables
from quire.queries import ORACLES, query
from quire.session import table


def _blocks(spark, sf):
    return tables.blocks(table(spark, sf, "page_blocks"))


def _header(x: str) -> str:
    first = "substr(w, 1, 1)"
    titled = f"len(list_filter(string_split({x}, ' '), lambda w: {first} = upper({first}) and {first} <> lower({first})))"
    return f"({x} <> '' and length({x}) <= 120 and len(string_split({x}, ' ')) <= 12 and not regexp_matches({x}, '[.?!]$') and (({x} = upper({x}) and {x} <> lower({x})) or {titled} >= 0.7 * len(string_split({x}, ' '))))"


_WORDS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"
_TAB = "coalesce(block_kind = 'table_like' or block_role = 'table_like', false)"


@query("b12_overlapping_tables", f"""with {S.BLOCKS}, t as (select doc_id, page_num, block_id, {_WORDS} ws from blocks where ({_TAB}) and text is not null)
  select a.doc_id, a.block_id, min(b.block_id) first_id from t a join t b on a.doc_id = b.doc_id and a.page_num = b.page_num and b.block_id < a.block_id where len(list_intersect(a.ws, b.ws)) > 0 and len(list_intersect(a.ws, b.ws)) >= 0.9 * least(len(a.ws), len(b.ws)) group by 1, 2""")
def b12_overlap(spark, sf):
    return inline.overlapping_tables(_blocks(spark, sf))


@query("b13_table_places", f"""with {S.BLOCKS}, b as (select block_id, doc_id, page_num, reading_order_index r, {_TAB} is_table, list_filter({_WORDS}, lambda x: length(x) >= 3) ws from blocks where text is not null and doc_id is not null and page_num is not null),
  s as (select t.block_id, o.block_id other, coalesce(o.r, -1) r, len(list_intersect(t.ws, o.ws)) n from b t join b o on t.doc_id = o.doc_id and t.page_num = o.page_num where t.is_table and not o.is_table),
  m as (select *, row_number() over (partition by block_id order by n desc, r, other) rn from s where n > 0)
  select b.block_id, m.other after_id, coalesce(m.n, 0)::bigint n_shared from b left join m on b.block_id = m.block_id and rn = 1 where b.is_table""")
def b13(spark, sf):
    return inline.table_places(_blocks(spark, sf))


_PAT = "(^|[^A-Za-z])(" + "|".join(inline.INLINE_HEADINGS) + "): ?"


@query("c5_inline_segments", rf"""with {S.CHUNKS}, s as (select chunk_id, string_split(regexp_replace({S.squeezed("text")}, '{_PAT}', '\1' || chr(1) || '\2' || chr(2), 'g'), chr(1)) ps from chunks where text is not null),
  u as (select chunk_id, (i - 1)::int segment_no, ps[i] p from (select *, unnest(range(1, len(ps) + 1)) i from s)),
  v as (select chunk_id, segment_no, case when contains(p, chr(2)) then string_split(p, chr(2))[1] end heading, trim(case when contains(p, chr(2)) then string_split(p, chr(2))[-1] else p end) body from u) select * from v where heading is not null or body <> ''""")
def c5(spark, sf):
    return inline.inline_segments(_written(spark, sf)).distinct()


_SUB = "[" + ", ".join(f"{{'n': len(list_filter({list(ws)}, lambda w: contains(lower(text), w))), 'place': {-i}, 'subtopic': '{n}', 'cues': list_filter({list(ws)}, lambda w: contains(lower(text), w))}}" for i, (n, ws) in enumerate(inline.SUBTOPICS)) + "]"


@query("c6_subtopics", f"with {S.CHUNKS}, s as (select chunk_id, list_sort({_SUB})[-1] b from chunks where text is not null) select chunk_id, b.subtopic subtopic, b.cues cues from s where b.n > 0")
def c6(spark, sf):
    return inline.subtopics(_written(spark, sf)).dropDuplicates(["chunk_id"])


@query("c8_header_lines", f"with {S.CHUNKS}, l as (select chunk_id, list_transform({S.lines('text')}, lambda v: {S.squeezed('v')}) ls from chunks where text is not null), u as (select chunk_id, (i - 1)::int line_no, ls[i] line from (select *, unnest(range(1, len(ls) + 1)) i from l)) select * from u where {_header('line')}")
def c8(spark, sf):
    return inline.header_lines(_written(spark, sf)).distinct()


@query("c8_inline_labels", rf"""with {S.CHUNKS}, {_PARAS}, l as (select chunk_id, para_no, regexp_extract(para, '^([A-Z0-9][A-Za-z0-9 /-]{{1,60}}):\s', 1) label from paras)
  select * from l where label <> '' and len(string_split(label, ' ')) <= 6 and len(list_filter(string_split(label, ' '), lambda w: w = upper(w))) >= 0.8 * len(string_split(label, ' '))""")
def c8_labels(spark, sf):
    return C.paragraphs(_written(spark, sf)).select("chunk_id", "para_no", inline.inline_label(F.col("para")).alias("label")).where("label is not null").distinct()


@query("c9_inline_sections", f"""with {S.CHUNKS}, {_PARAS}, h as (select chunk_id, para_no, last_value(case when {_header('para')} then para end ignore nulls) over (partition by chunk_id order by para_no rows between unbounded preceding and current row) section from paras)
  select h.chunk_id, para_no, section, array_to_string(list_concat(coalesce(section_path, []::varchar[]), case when section is null then []::varchar[] else [section] end), ' > ') path,
  case when contains(lower(coalesce(section, '')), 'annex') or contains(lower(coalesce(section, '')), 'appendix') then 'appendix' when contains(lower(coalesce(section, '')), 'table') then 'table_section' when contains(lower(coalesce(section, '')), 'checklist') then 'checklist_section' when section is null then 'inherited' else 'report_section' end kind from h join chunks using (chunk_id)""")
def c9(spark, sf):
    return inline.inline_sections(_chunks(spark, sf))


@query("c14_slide_roles", rf"""with {S.CHUNKS}, l as (select chunk_id, {S.lines('text')} ls from chunks where chunk_strategy = 'presentation_slide' and text is not null), s as (select chunk_id, lower(coalesce(ls[1], '')) f, len(ls) n, len(list_filter(ls, lambda x: regexp_matches(x, '^(?:[-*•]|\(?[0-9a-z]{{1,2}}[.)])\s')))::int n_bullets from l)
  select chunk_id, case when n <= 2 then 'title_slide' when {S.any_of('f', ('agenda', 'contents', 'index'))} then 'agenda' when {S.any_of('f', ('summary', 'review', 'conclusion'))} then 'summary' when n_bullets * 2 >= n then 'list_slide' else 'content' end as role, n_bullets from s""")
def c14(spark, sf):
    return inline.slide_roles(_written(spark, sf)).dropDuplicates(["chunk_id"])


def _packed(units: str, fits: str, grown: str, key: str) -> str:
    """A recursive SQL walk over units (key, i, len): the segment each falls into."""
    on = " and ".join(f"u.{k} is not distinct from r.{k}" for k in key.split(", "))
    return f"""walk as (select {', '.join('u.' + k for k in key.split(', '))}, u.i, u.len cur, 0 seg from {units} u where u.i = 1 union all
  select {', '.join('u.' + k for k in key.split(', '))}, u.i, case when {fits} then {grown} else u.len end, case when {fits} then r.seg else r.seg + 1 end from walk r join {units} u on {on} and u.i = r.i + 1)"""


_SENTS = r"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


#: SQL of the greedy packings, whose queries stand in catalog/chunks.py.
ORACLES["c4_packed_segments"] = f"""with recursive {S.CHUNKS}, s as (select chunk_id, {_SENTS} ss from chunks where text is not null), u as (select chunk_id, i, ss[i] sentence, length(ss[i])::bigint len from (select *, unnest(range(1, len(ss) + 1)) i from s)),
  {_packed("u", "r.cur + 1 + u.len <= 650", "r.cur + 1 + u.len", "chunk_id")} select w.chunk_id, seg::int segment_no, string_agg(sentence, ' ' order by w.i) segment from walk w join u on w.chunk_id = u.chunk_id and w.i = u.i group by 1, 2"""
ORACLES["c11_size_packing"] = f"""with recursive {S.BLOCKS}, u as (select doc_id, page_num, row_number() over (partition by doc_id, page_num order by reading_order_index nulls first, block_id) i, length(text)::bigint len from blocks where text is not null),
  {_packed("u", "r.cur + u.len <= 1200", "r.cur + u.len", "doc_id, page_num")} select w.doc_id, w.page_num, seg::int pack_no, count(*)::int n_blocks, sum(len)::int n_chars from walk w join u on w.doc_id is not distinct from u.doc_id and w.page_num is not distinct from u.page_num and w.i = u.i group by 1, 2, 3"""
