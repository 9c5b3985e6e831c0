"""Queries over page blocks."""

from pyspark.sql import functions as F

from quire.catalog import sql as S
from quire.operators import blocks as B
from quire.operators import tables
from quire.queries import query
from quire.session import table


def _blocks(spark, sf):
    return tables.blocks(table(spark, sf, "page_blocks"))


@query("b1_bbox_clamp", f"with {S.BLOCKS} select block_id, greatest(0, least(1, bbox[1])) x0, greatest(0, least(1, bbox[2])) y0, greatest(0, least(1, bbox[3])) x1, greatest(0, least(1, bbox[4])) y1 from blocks where bbox is not null")
def b1(spark, sf):
    b = B.clamped_bbox(F.col("bbox"))
    return _blocks(spark, sf).where("bbox is not null").select("block_id", *[F.element_at(b, i + 1).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("b3_reading_order")
def b3(spark, sf):
    return B.reading_order(_blocks(spark, sf))


_KEYED = r"(regexp_matches(n, '^[A-Za-z][A-Za-z0-9/&,\-\s]{2,40}\s*[:\-]\s+\S') or colons >= 2)"
_B4 = rf"""with {S.BLOCKS},
a as (select block_id, coalesce(text, '') as t from blocks),
b as (select *, {S.squeezed("t")} as n, lower({S.squeezed("t")}) as low, len({S.lines("t")}) as k from a),
c as (select *, len(regexp_extract_all(low, '[a-z0-9]+')) as tok, length(n) - length(replace(n, ':', '')) as colons, length(n) - length(regexp_replace(n, '[0-9]', '', 'g')) as digits from b),
d as (select *,
  regexp_matches(ltrim(t, chr(32) || chr(9) || chr(10) || chr(13)), '^(?:[-*•]|\d+[).])\s+') as is_list,
  regexp_matches(low, '\btable\b|\bcolumn\b|\brow\b|\bfigure\b') and (contains(n, ':') or contains(n, '|') or contains(t, chr(9))) as is_table,
  {_KEYED} and {S.any_of("low", ("form", "registration", "address", "date of birth"))} as is_form,
  regexp_matches(n, '(?:^|[^\p{{L}}\p{{N}}_])[A-Za-z][A-Za-z0-9/&,\-\s]{{2,24}}\s*[:\-]\s+\S') as compact,
  k <= 2 and ((n = upper(n) and n <> lower(n)) or regexp_matches(low, '^(?:chapter|part|appendix|section)\b') or (tok <= 10 and not regexp_matches(n, '[.?!]$'))) as is_head from c),
e as (select *, case when n = '' then 'unknown' when is_list and {S.any_of("low", ("checklist", "confirm", "verify", "screening"))} then 'checklist_item' when is_list then 'list_item' when is_table then 'table_like' when is_form then 'form_field' when compact then 'key_value' when is_head then 'heading' else 'paragraph' end as role,
  case when n = '' then 'unknown' when is_list then 'list' when is_table then 'table_like' when is_form or compact then 'text' when is_head then 'heading' else 'text' end as kind from d),
f as (select *, {S.labels([("colon_heavy", "colons >= 1"), ("dense_paragraph", "tok >= 60"), ("digit_heavy", "digits >= greatest(3, floor(length(n) / 10))"), ("domain_signal", S.any_of("low", B.DOMAIN_WORDS)), ("empty", "n = ''"), ("heading_like", "kind = 'heading'"), ("list_like", "kind = 'list'"), ("multi_line", "k >= 3"), ("question_like", "regexp_matches(n, '^[0-9]+[).]?\\s+') or ends_with(n, '?')"), ("structured_signal", S.any_of("low", B.STRUCTURE_WORDS)), ("table_like", "kind = 'table_like'")])} as flags from e),
g as (select *, case when role in ('table_like', 'form_field', 'key_value') then 1 else 0 end as tab from f)
select block_id, kind as block_kind, role as block_role, greatest(k, 1)::int as line_count, tok::int as token_count,
  greatest(0.15, least(0.98, round((0.62 + case when role = 'heading' then 0.12 else 0 end + 0.08 * tab + case when list_contains(flags, 'structured_signal') then 0.05 else 0 end + case when list_contains(flags, 'multi_line') then 0.04 else 0 end
    - case when tok <= 1 then 0.18 else 0 end - case when length(n) < 12 then 0.1 else 0 end - case when list_contains(flags, 'digit_heavy') then 0.08 * (1 - tab) else 0 end)::double, 3)))::double as text_quality_score, flags as structural_flags from g"""


@query("b4_block_classifier", _B4)
def b4(spark, sf):
    return B.classified(table(spark, sf, "page_blocks")).dropDuplicates(["block_id"])  # redeliveries are equal, so no text is shuffled


@query("b5_heading_promotion", f"""with {S.BLOCKS}, {S.HEADS},
  b as (select block_id, doc_id, relative_font_size r, font_is_bold f, lower({S.squeezed("text")}) n, len({S.lines("text")}) k from blocks where text is not null),
  toc as (select distinct doc_id, lower({S.squeezed("e")}) n from (select doc_id, unnest(toc) e from heads))
  select block_id, reason from (select block_id, case when toc.n is not null then 'toc' when r >= 1.18 then 'font_size' when f then 'bold' end reason
  from b left join toc on b.doc_id = toc.doc_id and b.n = toc.n where k <= 2 and len(string_split(b.n, ' ')) <= 18 and b.n <> '') where reason is not null""")
def b5(spark, sf):
    return B.promoted_headings(_blocks(spark, sf), tables.heads(table(spark, sf, "doc_heads")))


@query("b6_layout_signals", f"""with {S.BLOCKS}, g as (select doc_id, page_num, count(*) filter (block_role = 'table_like') tables, count(*) filter (block_role in ('form_field', 'key_value')) forms, count(*) filter (block_role in ('checklist_item', 'list_item')) items,
  count(*) filter (block_role = 'heading') headings, bool_or(coalesce(list_contains(structural_flags, 'question_like'), false)) question, bool_or(coalesce(list_contains(structural_flags, 'digit_heavy'), false)) digit,
  count(*) filter (len(bbox) = 4) boxes, count(*) filter (len(bbox) = 4 and bbox[3] - bbox[1] <= 0.45) narrow, count(*) filter (len(bbox) = 4 and bbox[3] - bbox[1] <= 0.45 and (bbox[1] + bbox[3]) / 2 < 0.42) l, count(*) filter (len(bbox) = 4 and bbox[3] - bbox[1] <= 0.45 and (bbox[1] + bbox[3]) / 2 > 0.58) r from blocks group by 1, 2)
  select doc_id, page_num, {S.labels([("table_dense", "tables >= 1"), ("form_dense", "forms >= 1"), ("list_dense", "items >= 2"), ("heading_dense", "headings >= 2"), ("question_rich", "question"), ("numeric_heavy", "digit and tables = 0"), ("multi_column_like", "boxes >= 4 and narrow >= 4 and l >= 2 and r >= 2")])} signals from g""")
def b6(spark, sf):
    return B.layout_signals(_blocks(spark, sf))


@query("b7_ocr_routing", rf"""with {S.BLOCKS}, t as (select doc_id, page_num, length(trim(t)) chars, contains(t, '�') bad, len(regexp_extract_all(t, '[\x00-\x08\x0E-\x1F\x{{7F}}-\x{{9F}}]')) control, length(t) len, len(regexp_extract_all(t, '\S+')) tok, len(list_filter(string_split_regex(t, '\s+'), lambda x: regexp_matches(x, '{B.ODD_TOKEN.replace("'", "''")}'))) odd from (select *, coalesce(text, '') t from blocks)),
  g as (select doc_id, page_num, sum(chars) chars, sum(control) control, sum(len) len, sum(tok) tok, sum(odd) odd, bool_or(bad) bad from t group by 1, 2)
  select doc_id, page_num, chars < 40 needs_ocr, {S.labels([("short_text", "chars < 80"), ("bad_unicode", "bad"), ("unprintable", "control > 0.05 * len"), ("non_lexical", "odd >= 0.25 * greatest(tok, 1)")])} reasons from g""")
def b7(spark, sf):
    return B.ocr_routing(_blocks(spark, sf))


@query("b8_engine_disagreements", """select distinct p.doc_id, p.page_num, p.needs_ocr from doc_pages p join inspector_results i on p.doc_id = i.doc_id
  where p.needs_ocr is not null and i.pages_needing_ocr is not null and p.needs_ocr <> list_contains(i.pages_needing_ocr, p.page_num + 1)""")
def b8(spark, sf):
    return B.engine_disagreements(table(spark, sf, "doc_pages"), table(spark, sf, "inspector_results"))


@query("b10_role_profile", f"""with {S.BLOCKS}, g as (select doc_id, count(*) n_blocks, {", ".join(f"count(*) filter (block_role = '{r}') n_{r}" for r in ("heading", "paragraph", "list_item", "checklist_item", "table_like", "form_field", "key_value"))}, round(avg(text_quality_score), 3) mean_score from blocks group by 1),
  s as (select doc_id, string_agg(text_source || '=' || n, ',' order by text_source || '=' || n) sources from (select doc_id, text_source, count(*) n from blocks where text_source is not null group by 1, 2) group by 1)
  select g.*, s.sources from g left join s on g.doc_id = s.doc_id""")
def b10(spark, sf):
    return B.role_profile(_blocks(spark, sf))


@query("b14_renumbering", f"with {S.BLOCKS} select block_id, doc_id, row_number() over (partition by doc_id order by page_num nulls first, reading_order_index nulls first, block_id) - 1 as order_no from blocks")
def b14(spark, sf):
    return B.renumbered(_blocks(spark, sf))


@query("b15_title_guess", f"""with {S.BLOCKS}, a as (select doc_id, page_num, reading_order_index, block_id, {S.lines("text")}[1] title from blocks where text is not null),
  r as (select *, row_number() over (partition by doc_id order by page_num nulls first, reading_order_index nulls first, block_id) rn from a where length(title) between 5 and 160) select doc_id, title from r where rn = 1""")
def b15(spark, sf):
    return B.title_guesses(_blocks(spark, sf))


@query("b16_summary_cues", rf"""with {S.BLOCKS}, a as (select doc_id, page_num, reading_order_index, block_id, {S.lines("text")} ls from blocks where text is not null),
  u as (select doc_id, page_num, reading_order_index, block_id, i, ls[i] cue from (select *, unnest(range(1, len(ls) + 1)) i from a)),
  x as (select * from u where length(cue) between 5 and 120 and (regexp_matches(lower(cue), '^(?:chapter|part|appendix|section)\b') or (cue = upper(cue) and regexp_matches(cue, '[A-Z]{{3}}')))),
  f as (select *, row_number() over (partition by doc_id, cue order by page_num nulls first, reading_order_index nulls first, block_id, i) q from x),
  r as (select doc_id, cue, row_number() over (partition by doc_id order by page_num nulls first, reading_order_index nulls first, block_id, i, cue) pos from f where q = 1) select doc_id, pos::int pos, cue from r where pos <= 10""")
def b16(spark, sf):
    return B.summary_cues(_blocks(spark, sf))


@query("b17_discovery_terms", rf"""with {S.BLOCKS}, a as (select doc_id, page_num, reading_order_index, block_id, regexp_extract_all(lower(text), '[a-z]{{4,}}') ws from blocks where text is not null),
  u as (select doc_id, page_num, reading_order_index, block_id, i, ws[i] term from (select *, unnest(range(1, len(ws) + 1)) i from a)),
  f as (select *, row_number() over (partition by doc_id, term order by page_num nulls first, reading_order_index nulls first, block_id, i) q from u where not list_contains({S.STOP}, term)),
  r as (select doc_id, term, row_number() over (partition by doc_id order by page_num nulls first, reading_order_index nulls first, block_id, i, term) pos from f where q = 1) select doc_id, pos::int pos, term from r where pos <= 20""")
def b17(spark, sf):
    return B.discovery_terms(_blocks(spark, sf))
