"""Queries over layout, rendering and diagnostics, and over the star schema."""

from pyspark.sql import functions as F

from quire.catalog import sql as S
from quire.catalog.planning import _CONF, _FAM, _INTENT, _heads, _queries
from quire.catalog.retrieval import _AL, _EV, _FOLD, _PACK, _RER, _RH, _bucketed, _chunks, _claims, _run_hits, _top
from quire.operators import answers, diagnostics, layout, planning, rendering, retrieval, tables
from quire.queries import query
from quire.session import cut_lineage, table


def _blocks(spark, sf):
    return tables.blocks(table(spark, sf, "page_blocks"))


@query("b2_column_counts")
def b2(spark, sf):
    return layout.column_counts(_blocks(spark, sf))


@query("b9_page_fusion", f"""with {S.BLOCKS}, g as (select doc_id, page_num, sum(case when extraction_method in ('ocr', 'mixed') then p end) o, sum(case when extraction_method not in ('ocr', 'mixed') then p end) n, bool_or(coalesce(block_role in ('table_like', 'form_field', 'key_value'), false)) grid
  from (select *, length(text) / 200.0::double * coalesce(text_quality_score, 0.5) p from blocks where text is not null and extraction_method is not null) group by 1, 2)
  select doc_id, page_num, case when o is null then 'native' when n is null then 'ocr' when grid then 'native' when round(o - n, 6) >= 2.5 then 'ocr' else 'merged' end choice from g""")
def b9(spark, sf):
    return layout.fused_pages(_blocks(spark, sf))


@query("b11_markdown_tables", rf"""with {S.CHUNKS}, t as (select chunk_id, regexp_extract_all(text, '(?m)^(\|[^\n]*\|[ \t]*\r?\n\|[-:| \t]+\|[ \t]*(?:\r?\n\|[^\n]*\|[ \t]*)+)', 1) ts from chunks where text is not null),
  u as (select chunk_id, (i - 1)::int table_no, ts[i] table_text from (select *, unnest(range(1, len(ts) + 1)) i from t)) select chunk_id, table_no, table_text, (len(string_split(table_text, chr(10))) - 2)::int n_rows from u where length(regexp_replace(table_text, '[^A-Za-z0-9]', '', 'g')) >= 40""")
def b11(spark, sf):
    return layout.markdown_tables(_chunks(spark, sf))


@query("b12_duplicate_tables", f"""with {S.BLOCKS}, t as (select doc_id, page_num, block_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))), ' ') sig from blocks where block_kind = 'table_like' and text is not null),
  g as (select *, min(block_id) over (partition by doc_id, page_num, sig) first_id from t) select doc_id, page_num, block_id, first_id from g where block_id <> first_id""")
def b12(spark, sf):
    return layout.duplicate_tables(_blocks(spark, sf))


@query("r4_structural_signal", rf"""with {S.CHUNKS}, c as (select chunk_id, regexp_extract(lower(concat_ws(' ', section_title, text)), '\bappendix\s+([a-z0-9]+)\b', 1) a, regexp_extract(lower(concat_ws(' ', section_title, text)), '\btable\s+([a-z0-9][a-z0-9\-.]*)\b', 1) t, regexp_extract(lower(concat_ws(' ', section_title, text)), '\bquestion\s+([0-9]+)\b', 1) q from chunks)
  select chunk_id, (case when a = '' then -1.0 when a = 'b' then 4.0 else -6.0 end + case when t = '' then -1.0 when t = '2' then 4.0 else -6.0 end)::double structural from c""")
def r4(spark, sf):
    return _chunks(spark, sf).select("chunk_id", retrieval.structural_signal(F.lit("see Appendix B and table 2"), F.concat_ws(" ", "section_title", "text")).alias("structural"))


@query("r4_case_signals", f"with {_RER} select query_id, chunk_id, structural_signal structural from rer")
def r4_cases(spark, sf):
    return retrieval.reranked(_queries(spark, sf), _chunks(spark, sf)).select("query_id", "chunk_id", F.col("structural_signal").alias("structural"))


@query("a4_sentence_budgets", f"with q as (select case_id query_id, query from eval_cases), qi as (select query_id, {_INTENT} intent from (select *, lower(coalesce(query, '')) l from q)) select query_id, intent, case intent when 'definition' then 1 when 'document_overview' then 4 when 'source_listing' then 4 when 'cross_document_compare' then 4 else 3 end budget from qi")
def a4(spark, sf):
    q = _queries(spark, sf).select("query_id", planning.intent(F.col("query")).alias("intent"))
    return q.select("query_id", "intent", rendering.sentence_budget(F.col("intent")).alias("budget"))


@query("a6_snippets", f"""with {_RER}, dv as (select *, case when row_number() over (partition by query_id, doc_id order by rank) > 1 then 1 else 0 end late from rer), tp as (select * from (select query_id, chunk_id, doc_id, row_number() over (partition by query_id order by late, rank) nr from dv) where nr <= 5),
  b as (select query_id, arg_min(doc_id, nr) doc_id from tp group by 1), h as (select t.*, row_number() over (partition by t.query_id order by nr) r from tp t join b on t.query_id = b.query_id and t.doc_id = b.doc_id)
  select h.query_id, h.doc_id, string_agg(rtrim(substr({S.squeezed('c.text')}, 1, 240)), ' … ' order by r) snippet from h join chunks c using (chunk_id) where r <= 3 group by 1, 2""")
def a6(spark, sf):
    return rendering.snippets(_top(spark, sf).select("query_id", "chunk_id", "doc_id", F.col("new_rank").alias("rank")), _chunks(spark, sf))


@query("a7_label_fields", rf"""with {S.CHUNKS}, l as (select chunk_id, list_filter({S.lines('text')}, lambda x: regexp_matches(x, '^[^:=_.\n]{{2,40}}:\s+\S')) ls from chunks where text is not null)
  select chunk_id, (i - 1)::int field_no, trim(regexp_extract(ls[i], '^([^:]+):', 1)) as label, trim(regexp_extract(ls[i], '^[^:]+:\s+(.*)$', 1)) as value from (select *, unnest(range(1, len(ls) + 1)) i from l)""")
def a7(spark, sf):
    return rendering.label_fields(_chunks(spark, sf))


@query("a9_dominant_docs", _RH + ", g as (select run_key, doc_id, count(*) n, sum(count(*)) over (partition by run_key) t from rh group by 1, 2) select run_key, doc_id, n from g where n >= 2 and n * 2 > t")
def a9(spark, sf):
    return rendering.dominant_docs(_run_hits(spark, sf), "run_key")


@query("a11_overviews", "with " + _CONF + ", pv as (" + _FAM.split("pv as (", 1)[1] + """ select h.doc_id, concat_ws(' ', coalesce(h.title, 'This document'), case when s.confidence >= 0.8 then 'is' when s.confidence >= 0.62 then 'looks like' else 'may be' end, 'a', replace(f.family, '_', ' '), case when h.page_count is not null then 'of ' || h.page_count || ' pages' end) overview from heads h join sem s on h.doc_id = s.doc_id join fam f on h.doc_id = f.doc_id""")
def a11(spark, sf):
    return rendering.overviews(_heads(spark, sf))


@query("a19_joined_evidence", f"with {_EV}, pk as (select * from ev where pick <= 4) select p.query_id, string_agg(s.sentence, ' ' order by p.pick) answer, count(*)::int n_sentences, count(distinct p.chunk_id) n_chunks from pk p join sc s on p.query_id = s.query_id and p.chunk_id = s.chunk_id and p.sentence_no = s.sentence_no group by 1")
def a19(spark, sf):
    sc = answers.scored_sentences(_queries(spark, sf), _top(spark, sf), _chunks(spark, sf))
    return rendering.joined_evidence(answers.selected_evidence(sc), sc)


@query("a17_answers")
def a17(spark, sf):
    return rendering.answered(_queries(spark, sf), _chunks(spark, sf))


@query("m4_support_ratio", _AL + ", g as (select run_key, round(avg((status in ('exact', 'fragment'))::int), 6) ratio from al group by 1) select run_key, ratio, case when ratio >= 0.67 then 'pass' else 'fail' end verdict from g")
def m4(spark, sf):
    return diagnostics.support_ratio(_claims(spark, sf), "run_key")


def _results(spark, sf):
    """As the SQL of m5 and m6 has it: retrieval taken as perfect, coverage of the case's own passage. ``_retrieved_results`` measures both."""
    from quire.operators import metrics

    cases = table(spark, sf, "eval_cases")
    ev = answers.selected_evidence(answers.scored_sentences(_queries(spark, sf), _top(spark, sf), _chunks(spark, sf)))
    ab = answers.abstentions(_queries(spark, sf), ev).select(F.col("query_id").alias("case_id"), F.col("abstain").alias("abstained"))
    return cases.select("case_id", F.col("passage").isNull().alias("negative")).join(ab, "case_id").join(metrics.keyword_coverage(cases), "case_id").withColumn("reciprocal_rank", F.lit(1.0)).withColumn("recall", F.lit(1.0))


_ST = f"""with {_EV}, g as (select query_id, max(score) m from ev where pick <= 4 group by 1), r as (select e.case_id, e.passage is null negative, coalesce(g.m, 0) < 2 abstained, coalesce(e.expected_keywords, []::varchar[]) kw, lower(coalesce(e.passage, '')) t from eval_cases e left join g on e.case_id = g.query_id),
c as (select *, case when len(kw) = 0 then 0.0 else len(list_filter(kw, lambda k: contains(t, lower(k)) or contains(regexp_replace(t, '[^\\p{{L}}\\p{{N}}]', '', 'g'), regexp_replace(lower(k), '[^\\p{{L}}\\p{{N}}]', '', 'g')))) / len(kw) end cov from r),
st as (select *, case when negative and abstained then 'pass' when negative then 'negative_fail' when abstained then 'fail' when cov < 1 then 'answer_warning' else 'pass' end status from c)"""


@query("m5_case_status", _ST + " select case_id, status from st")
def m5(spark, sf):
    return diagnostics.case_status(_results(spark, sf))


@query("m6_suite_summary", _ST + " select count(*) n_cases, 1.0::double mean_recall, 1.0::double mrr, round(avg(case when not negative then cov end), 6)::double mean_coverage, count(*) filter (negative) n_negative, count(*) filter (not negative and status <> 'pass') n_warnings from st")
def m6(spark, sf):
    r = _results(spark, sf)
    return diagnostics.suite_summary(r, diagnostics.case_status(r))


def _retrieved_results(spark, sf):
    """The suite with retrieval counted: hits against chunks that hold all expected keywords, coverage of the evidence."""
    from quire.operators import metrics

    cases, q, chunks, top = table(spark, sf, "eval_cases"), _queries(spark, sf), _chunks(spark, sf), cut_lineage(_top(spark, sf))
    as_case = lambda df: df.withColumnRenamed("query_id", "case_id")
    sc = cut_lineage(answers.scored_sentences(q, top, chunks))
    ev = answers.selected_evidence(sc)
    hits = as_case(top).select("case_id", F.col("chunk_id").alias("item"), F.col("new_rank").alias("rank"))
    return cut_lineage(diagnostics.case_results(cases, hits, metrics.keyword_relevance(cases, chunks), as_case(rendering.joined_evidence(ev, sc)), as_case(answers.abstentions(q, ev))))


_RST = f"""with {_EV}, pk as (select * from ev where pick <= 4), an as (select p.query_id, string_agg(s.sentence, ' ' order by p.pick) answer, max(p.score) m from pk p join sc s on p.query_id = s.query_id and p.chunk_id = s.chunk_id and p.sentence_no = s.sentence_no group by 1),
kt as (select distinct case_id, unnest(regexp_extract_all(lower(array_to_string(expected_keywords, ' ')), '[\\p{{L}}\\p{{N}}]+')) term from eval_cases), kn as (select case_id, count(*) n from kt group by 1), wt as (select distinct chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) term from chunks where text is not null),
rl as (select kt.case_id, wt.chunk_id from kt join wt using (term) join kn on kt.case_id = kn.case_id group by kt.case_id, wt.chunk_id, kn.n having count(*) = kn.n), rn as (select case_id, count(*) n_rel from rl group by 1),
t5 as (select * from (select query_id, chunk_id, row_number() over (partition by query_id order by late, rank) nr from dv) where nr <= 5), rk as (select t5.query_id case_id, count(rl.chunk_id) hit, min(case when rl.chunk_id is not null then nr end) f from t5 left join rl on t5.query_id = rl.case_id and t5.chunk_id = rl.chunk_id group by 1),
r as (select e.case_id, e.passage is null negative, coalesce(an.m, 0) < 2 abstained, coalesce(e.expected_keywords, []::varchar[]) kw, coalesce(an.answer, '') t, coalesce(round(rk.hit / rn.n_rel, 6), 0.0)::double recall, coalesce(round(1.0 / rk.f, 6), 0.0)::double rr from eval_cases e left join an on e.case_id = an.query_id left join rk on e.case_id = rk.case_id left join rn on e.case_id = rn.case_id),
c as (select *, (case when len(kw) = 0 then 0.0 else round(len(list_filter(kw, lambda k: contains({_FOLD.format('t')}, {_FOLD.format('k')}) or contains({_PACK.format('t')}, {_PACK.format('k')}))) / len(kw), 6) end)::double cov from r),
st as (select *, case when negative and abstained then 'pass' when negative then 'negative_fail' when abstained then 'fail' when rr < 1 or recall < 1 then 'retrieval_warning' when cov < 1 then 'answer_warning' else 'pass' end status from c)"""


@query("m5_retrieval_status", _RST + " select case_id, recall, rr reciprocal_rank, cov coverage, status from st")
def m5_retrieval(spark, sf):
    r = _retrieved_results(spark, sf)
    return r.select("case_id", "recall", "reciprocal_rank", "coverage").join(diagnostics.case_status(r), "case_id")


@query("m6_retrieval_summary", _RST + " select count(*) n_cases, round(avg(case when not negative then recall end), 6)::double mean_recall, round(avg(case when not negative then rr end), 6)::double mrr, round(avg(case when not negative then cov end), 6)::double mean_coverage, count(*) filter (negative) n_negative, count(*) filter (not negative and status <> 'pass') n_warnings from st")
def m6_retrieval(spark, sf):
    r = _retrieved_results(spark, sf)
    return diagnostics.suite_summary(r, diagnostics.case_status(r))


@query("m8_layers", """with v as (select 'processing' as layer, confidence as value, 0.5::double threshold from inspector_results union all select 'structure', structure_confidence, 0.3::double from (select * exclude (rn) from (select *, row_number() over (partition by doc_id order by registered_at desc nulls last) rn from doc_heads) where rn = 1))
  select layer, count(*) n, round(avg(value), 6) mean, bool_and(coalesce(value >= threshold, false)) all_pass from v group by 1""")
def m8(spark, sf):
    a = table(spark, sf, "inspector_results").select(F.lit("processing").alias("layer"), F.col("confidence").alias("value"), F.lit(0.5).alias("threshold"))
    b = _heads(spark, sf).select(F.lit("structure").alias("layer"), F.col("structure_confidence").alias("value"), F.lit(0.3).alias("threshold"))
    return diagnostics.layer_summary(a.unionByName(b))


@query("m18_processing_flags", f"""with {S.HEADS}, p as (select doc_id, count(*) n, count(*) filter (ocr_used) ocr, count(*) filter (extraction_engine_disagreement) dis, count(*) filter (char_count < 40) thin from (select distinct doc_id, page_num, char_count, ocr_used, extraction_engine_disagreement from doc_pages) group by 1),
  j as (select h.doc_id, {S.labels([('no_title', 'title is null'), ('weak_structure', 'coalesce(structure_confidence < 0.5, false)'), ('mostly_ocr', 'coalesce(ocr * 2 > n, false)'), ('engines_differ', 'coalesce(dis > 0, false)'), ('thin_pages', 'coalesce(thin > 0, false)'), ('encoding', 'coalesce(has_encoding_issues, false)'), ('not_inspected', 'i.status is null')])} flags
  from heads h left join p on h.doc_id = p.doc_id left join inspector_results i on h.doc_id = i.doc_id) select doc_id, flags, case when len(flags) >= 2 then 'review' when len(flags) = 1 then 'warn' else 'pass' end status from j""")
def m18(spark, sf):
    return diagnostics.processing_flags(_heads(spark, sf), table(spark, sf, "doc_pages"), table(spark, sf, "inspector_results"))


@query("s15_upload_rejections", f"with {S.HEADS} select doc_id as name, 'too_many_pages' reason from heads where page_count > 20")
def s15(spark, sf):
    f = _heads(spark, sf).select(F.col("doc_id").alias("name"), F.lit("%PDF-1.7").alias("head"), F.lit(1000).alias("length"), "page_count")
    return diagnostics.upload_rejections(f, most_pages=20)


@query("u4_slugs", rf"with {S.HEADS} select doc_id, regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') slug from heads")
def u4(spark, sf):
    from quire.functions import text as T

    return _heads(spark, sf).select("doc_id", T.slug(F.coalesce("title", F.lit(""))).alias("slug"))


# --- star schema and events ------------------------------------------------------


@query("star_pricing_summary", """select l_returnflag, l_linestatus, sum(l_quantity)::double sum_qty, round(sum(l_extendedprice * (1 - l_discount))::double, 2) revenue, count(*) n from lineitem where l_shipdate <= date '1998-09-02' group by 1, 2""")
def star1(spark, sf):
    li = table(spark, sf, "lineitem").where("l_shipdate <= date '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double"), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("star_nation_revenue", """select n_name, count(distinct o_orderkey) n_orders, round(sum(l_extendedprice * (1 - l_discount))::double, 2) revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey group by 1""")
def star2(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
    j = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o, F.expr("l_orderkey = o_orderkey")).join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.expr("c_nationkey = n_nationkey"))
    return j.groupBy("n_name").agg(F.count_distinct("o_orderkey").alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double"), 2).alias("revenue"))


@query("events_hourly", "select date_trunc('hour', ts) as hour, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2")
def events_hourly(spark, sf):
    return table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
