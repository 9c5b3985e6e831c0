"""Queries over sections."""

from quire.catalog import sql as S
from quire.operators import sections as X
from quire.operators import tables
from quire.queries import query
from quire.session import table

_W = r"(?:[^\p{L}\p{N}_]|$)"
_H = rf"""{S.BLOCKS}, {S.HEADS},
b as (select block_id, doc_id, page_num, reading_order_index, {S.squeezed("text")} n, string_split({S.squeezed("text")}, ' ') w from blocks where text is not null),
toc as (select distinct doc_id, lower({S.squeezed("e")}) k from (select doc_id, unnest(toc) e from heads)),
c as (select b.*, toc.k is not null as in_toc, n = upper(n) and n <> lower(n) as caps, regexp_matches(n, '^[0-9]+(?:\.[0-9]+){{0,3}}(?:[).:-]|\s)') as numbered, regexp_extract(n, '^([0-9]+(?:\.[0-9]+){{0,3}})', 1) as num,
  len(list_filter(w, lambda x: substr(x, 1, 1) = upper(substr(x, 1, 1)) and substr(x, 1, 1) <> lower(substr(x, 1, 1)))) as titled from b left join toc on b.doc_id = toc.doc_id and toc.k = lower(b.n) and length(b.n) <= 160),
h as (select *, n <> '' and (in_toc or regexp_matches(lower(n), '^(?:chapter|part|appendix|section){_W}') or (len(w) <= 14 and not regexp_matches(n, '[.?!]$') and (caps or numbered or regexp_matches(lower(n), '^question\s+[0-9]+{_W}') or (titled / len(w) >= 0.75 and length(n) <= 90)))) as is_heading from c),
heading as (select block_id, doc_id, page_num, reading_order_index, is_heading, case when is_heading then n end as title,
  (case when not is_heading then null when in_toc or regexp_matches(lower(n), '^(?:chapter|part|appendix){_W}') then 1 when regexp_matches(lower(n), '^section{_W}') then 2 when numbered then least(length(num) - length(replace(num, '.', '')) + 1, 4) when caps then 1 end)::int as level from h)"""
_SEG = _H + ", seg as (select *, sum(is_heading::int) over (partition by doc_id order by page_num nulls first, reading_order_index nulls first, block_id rows unbounded preceding)::bigint as section_no from heading)"
_SEC = _SEG + ", sec as (select doc_id, section_no, max(title) title, max(level) as level, min(page_num) + 1 page_start, max(page_num) + 1 page_end, count(*) n_blocks from seg group by 1, 2)"
_PAR = _SEC + ", up as (select s.doc_id, s.section_no, max(p.section_no) parent_no from sec s left join sec p on s.doc_id = p.doc_id and p.section_no < s.section_no and coalesce(p.level, 1) < s.level group by 1, 2)"
_PATH = _PAR + """, t as (select s.doc_id, s.section_no, coalesce(s.title, '') title, u.parent_no from sec s join up u on s.doc_id = u.doc_id and s.section_no = u.section_no)
  select a.doc_id, a.section_no, list_filter([d.title, c.title, b.title, a.title], lambda x: x is not null) as path from t a left join t b on a.doc_id = b.doc_id and a.parent_no = b.section_no left join t c on b.doc_id = c.doc_id and b.parent_no = c.section_no left join t d on c.doc_id = d.doc_id and c.parent_no = d.section_no"""
_KIND = _PAR + rf""", g as (select s.doc_id, s.section_no, coalesce(lower(max(s.title)), '') t, bool_or(coalesce(b.block_kind = 'table_like', false)) tab, bool_or(coalesce(b.block_role = 'table_like', false)) rtab, bool_or(coalesce(b.block_role in ('form_field', 'checklist_item', 'key_value'), false)) form, bool_or(coalesce(b.block_role = 'list_item', false)) lst, sum(length(b.text) - length(replace(b.text, ':', ''))) colons, count(*) n from seg s join blocks b on s.block_id = b.block_id group by 1, 2),
k as (select *, case when contains(t, 'appendix') then 'appendix' when contains(t, 'table') or tab then 'table_section' when regexp_matches(t, '^(?:question|section)\s+[0-9]+{_W}') then 'questionnaire_section' when contains(t, 'checklist') then 'checklist_section' when contains(t, 'introduction') or contains(t, 'background') then 'intro_section' when colons >= 3 then 'checklist_section' else 'report_section' end section_kind from g),
kind as (select doc_id, section_no, section_kind, case when section_kind = 'table_section' or rtab then 'table' when section_kind in ('questionnaire_section', 'checklist_section') or form then 'form' when lst then 'list' when section_kind = 'appendix' then 'appendix' when n <= 1 and t <> '' then 'heading_group' else 'prose' end section_role from k)"""


def _blocks(spark, sf):
    return tables.blocks(table(spark, sf, "page_blocks"))


def _headings(spark, sf):
    return X.headings(_blocks(spark, sf), tables.heads(table(spark, sf, "doc_heads")))


def _segmented(spark, sf):
    return X.segmented(_headings(spark, sf))


@query("x1_headings", f"with {_H} select block_id, title from heading where is_heading")
def x1(spark, sf):
    return _headings(spark, sf).where("is_heading").select("block_id", "title")


@query("x2_heading_levels", f"with {_H} select level, count(*) n from heading where is_heading group by 1")
def x2(spark, sf):
    return _headings(spark, sf).where("is_heading").groupBy("level").count().withColumnRenamed("count", "n")


@query("x3_segmentation", f"with {_SEG} select block_id, doc_id, section_no from seg")
def x3(spark, sf):
    return _segmented(spark, sf).select("block_id", "doc_id", "section_no")


@query("x4_sections", f"with {_SEC} select * from sec")
def x4(spark, sf):
    return X.section_table(_segmented(spark, sf))


@query("x6_section_parents", f"with {_PAR} select * from up")
def x6(spark, sf):
    return X.parents(X.section_table(_segmented(spark, sf)))


@query("x6_section_paths", f"with {_PATH}")
def x6_paths(spark, sf):
    s = X.section_table(_segmented(spark, sf))
    return X.paths(s, X.parents(s))


@query("x5_section_kinds", f"with {_KIND} select * from kind")
def x5(spark, sf):
    return X.kinds(_segmented(spark, sf), _blocks(spark, sf))


@query("x7_structure_confidence", f"""with {_KIND}, j as (select s.doc_id, least(1.0, 0.4 + case when s.title is not null then 0.15 else 0 end + case when s.level is not null then 0.15 else 0 end + case when u.parent_no is not null then 0.1 else 0 end + case when s.n_blocks > 1 then 0.1 else 0 end + case when k.section_role <> 'prose' then 0.05 else 0 end)::double c, case when coalesce(s.level, 0) > 1 then 1 else 0 end deep
  from sec s join up u on s.doc_id = u.doc_id and s.section_no = u.section_no join kind k on s.doc_id = k.doc_id and s.section_no = k.section_no)
  select doc_id, count(*) n_sections, least(1.0, round(avg(c) * 0.65 + 0.08 * max(deep) + 0.2, 6))::double structure_confidence from j group by 1""")
def x7(spark, sf):
    seg = _segmented(spark, sf)
    s = X.section_table(seg)
    return X.confidence(s, X.parents(s), X.kinds(seg, _blocks(spark, sf)))


@query("x8_block_sections", f"with {_SEC} select g.block_id, s.title section_title, s.page_start, s.page_end from seg g join sec s on g.doc_id = s.doc_id and g.section_no = s.section_no")
def x8(spark, sf):
    seg = _segmented(spark, sf)
    s = X.section_table(seg).select("doc_id", "section_no", "title", "page_start", "page_end").withColumnRenamed("title", "section_title")
    return seg.select("block_id", "doc_id", "section_no").join(s, ["doc_id", "section_no"]).select("block_id", "section_title", "page_start", "page_end")
