"""Queries over retrieval, answers and evaluation."""

from pyspark.sql import functions as F

from quire.catalog import sql as S
from quire.catalog.nested import _HITS, _OUTPUTS
from quire.catalog.planning import _INTENT
from quire.operators import answers, metrics, nested, retrieval, tables
from quire.queries import query
from quire.session import table

_NO = "[]::varchar[]"
_HARD = "[" + ",".join(f"'{x}'" for x in retrieval.HARD) + "]"
_SOFT = "[" + ",".join(f"'{x}'" for x in retrieval.SOFT) + "]"
_ADM = f"adm as (select * from chunks where not list_has_any(coalesce(noise_labels, {_NO}), {_HARD}) and coalesce(quality_score, 1.0) > 0.10)"
_QS = f"round(-(1.0 - coalesce(quality_score, 1.0)) * 6.0 - 0.75 * len(list_intersect(coalesce(noise_labels, {_NO}), {_SOFT})) - 0.15 * list_contains(coalesce(noise_labels, {_NO}), 'ocr_derived')::int, 6)"
_Q = "q as (select case_id query_id, query from eval_cases)"
_CAND = f"""{S.CHUNKS}, {_ADM}, {_Q}, qt as (select distinct query_id, unnest(regexp_extract_all(lower(query), '[a-z]{{2,}}')) term from q), qs as (select * from qt where not list_contains({S.QSTOP}, term)),
ct as (select distinct chunk_id, unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) term from adm where text is not null), sh as (select query_id, chunk_id, count(*) n_shared from ct join qs using (term) group by 1, 2),
cand as (select query_id, chunk_id, n_shared, vector_rank from (select *, row_number() over (partition by query_id order by n_shared desc, chunk_id) vector_rank from sh) where vector_rank <= 20)"""


def _ref(x: str, label: str, pat: str) -> str:
    return f"regexp_extract(lower({x}), '\\b{label}\\s+({pat})\\b', 1)"


_STRUCT = " + ".join(f"(case when {_ref('query', l, p)} = '' then 0.0 when {_ref('full_text', l, p)} = '' then -1.0 when {_ref('query', l, p)} = {_ref('full_text', l, p)} then 4.0 else -6.0 end)" for l, p in (("appendix", "[a-z0-9]+"), ("question", "[0-9]+"), ("table", r"[a-z0-9][a-z0-9\-.]*")))
_GRAM = lambda n, w: f"{w} * len(list_filter(list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))), lambda g: contains(lower(text), g)))"
_BON = " + ".join(f"(case when list_has_any(terms, {list(qs)}) and list_has_any(coalesce(content_hints, {_NO}), {list(hs)}) then {w} else 0.0 end)" for qs, hs, w in retrieval.HINT_BONUS)
_RULE = {
    "content_hints": lambda v: f"list_has_any(coalesce(content_hints, {_NO}), {list(v)})", "title_words": lambda v: f"list_has_any(regexp_extract_all(lower(coalesce(section_title, '')), '[a-z]+'), {list(v)})",
    "chunk_strategy": lambda v: f"coalesce(list_contains({list(v)}, chunk_strategy), false)", "first_pages": lambda v: "coalesce(page_start <= 2, false)",
}
_HEUR = " + ".join(f"(case when ({_INTENT}) = '{i}' and {_RULE[what](v)} then {w} else 0.0 end)" for i, what, v, w in retrieval.HIT_RULES)
_RER = f"""{_CAND}, j as (select c.*, q.query, d.doc_id, d.text, d.noise_labels, d.quality_score, d.content_hints, d.section_title, d.chunk_strategy, d.page_start, lower(coalesce(q.query, '')) l, concat_ws(' ', d.section_title, d.text) full_text, list_filter(regexp_extract_all(lower(q.query), '[a-z0-9]{{2,}}'), lambda x: not list_contains({S.QSTOP}, x)) w,
  list_filter(regexp_extract_all(lower(q.query), '[a-z]{{2,}}'), lambda x: not list_contains({S.QSTOP}, x)) terms from cand c join q using (query_id) join chunks d on c.chunk_id = d.chunk_id),
sg as (select query_id, chunk_id, doc_id, ({_QS})::double quality_signal, round(0.35 * n_shared + round({_GRAM(4, 1.8)} + {_GRAM(3, 1.35)} + {_GRAM(2, 0.95)}, 6) + {_BON}, 6)::double semantic_signal, ({_STRUCT})::double structural_signal, (-0.01 * (vector_rank - 1))::double rank_prior, ({_HEUR})::double metadata_signal from j),
tot as (select *, round(quality_signal + semantic_signal + structural_signal + metadata_signal + rank_prior, 6) total from sg), rer as (select *, (row_number() over (partition by query_id order by total desc, chunk_id))::int as rank from tot)"""


def _chunks(spark, sf):
    return tables.chunks(table(spark, sf, "chunk_records"))


def _queries(spark, sf):
    return table(spark, sf, "eval_cases").select(F.col("case_id").alias("query_id"), "query")


@query("r1_admitted", f"with {S.CHUNKS}, {_ADM} select chunk_id from adm")
def r1(spark, sf):
    return retrieval.admitted(_chunks(spark, sf)).select("chunk_id")


@query("r2_quality_signal", f"with {S.CHUNKS} select chunk_id, ({_QS})::double quality_signal from chunks")
def r2(spark, sf):
    return _chunks(spark, sf).select("chunk_id", retrieval.quality_signal().alias("quality_signal"))


@query("r3_candidates", f"with {_CAND} select query_id, chunk_id, n_shared, vector_rank::int vector_rank from cand")
def r3(spark, sf):
    return retrieval.candidates(_queries(spark, sf), _chunks(spark, sf))


@query("r6_prefix_terms", f"""with {_CAND}, j as (select c.query_id, c.chunk_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(q.query), '[a-z]{{2,}}'), lambda x: not list_contains({S.QSTOP}, x)))) t,
  list_transform(list_filter(regexp_extract_all(lower(d.text), '[a-z]{{3,}}'), lambda x: length(x) >= 4), lambda x: substr(x, 1, 5)) p from cand c join q using (query_id) join chunks d on c.chunk_id = d.chunk_id)
  select query_id, chunk_id, list_filter(t, lambda x: length(x) >= 4 and list_contains(p, substr(x, 1, 5))) shared from j""")
def r6(spark, sf):
    from quire.functions import text as T

    ch = _chunks(spark, sf)
    j = retrieval.candidates(_queries(spark, sf), ch).join(_queries(spark, sf), "query_id").join(ch.select("chunk_id", "text"), "chunk_id")
    return j.select("query_id", "chunk_id", retrieval.prefix_terms(T.query_terms(F.col("query")), T.words(F.col("text"), "[a-z]{3,}")).alias("shared"))


@query("r9_reranked", f"with {_RER} select query_id, chunk_id, doc_id, quality_signal, semantic_signal, structural_signal, rank_prior, metadata_signal, total, rank from rer")
def r9(spark, sf):
    return retrieval.reranked(_queries(spark, sf), _chunks(spark, sf))


@query("r11_diversified", f"with {_RER}, dv as (select *, case when row_number() over (partition by query_id, doc_id order by rank) > 1 then 1 else 0 end late from rer), nr as (select query_id, chunk_id, (row_number() over (partition by query_id order by late, rank))::int new_rank from dv) select * from nr where new_rank <= 5")
def r11(spark, sf):
    return retrieval.diversified(retrieval.reranked(_queries(spark, sf), _chunks(spark, sf)), ["query_id"]).select("query_id", "chunk_id", "new_rank")


_RH = _HITS + ", rh as (select distinct run_id::varchar || '#' || result_pos run_key, hit_pos, json_extract_string(e, '$.chunk_id') chunk_id, json_extract_string(e, '$.doc_id') doc_id from hits where json_type(e) = 'OBJECT' and json_extract_string(e, '$.chunk_id') is not null)"


def _run_hits(spark, sf):
    return nested.answer_hits(table(spark, sf, "answer_runs")).select(F.concat_ws("#", F.col("run_id").cast("string"), F.col("result_pos").cast("string")).alias("run_key"), "hit_pos", "chunk_id", "doc_id")


@query("r14_neighbours", _RH.replace("with trimmed", f"with {S.CHUNKS}, {_ADM}, trimmed", 1) + """, ok as (select chunk_id from adm where coalesce(quality_score, 1.0) >= 0.35), h as (select distinct run_key, chunk_id from rh),
  p1 as (select distinct h.run_key, c.preceding_chunk_id chunk_id from h join chunks c using (chunk_id) where c.preceding_chunk_id in (select chunk_id from ok)), p2 as (select distinct h.run_key, c.preceding_chunk_id chunk_id from p1 h join chunks c using (chunk_id) where c.preceding_chunk_id in (select chunk_id from ok)),
  f1 as (select distinct h.run_key, c.following_chunk_id chunk_id from h join chunks c using (chunk_id) where c.following_chunk_id in (select chunk_id from ok)), f2 as (select distinct h.run_key, c.following_chunk_id chunk_id from f1 h join chunks c using (chunk_id) where c.following_chunk_id in (select chunk_id from ok))
  select run_key, chunk_id, min(hop)::int hop from (select *, 0 hop from h union all select *, 1 from p1 union all select *, 1 from f1 union all select *, 2 from p2 union all select *, 2 from f2) group by 1, 2""")
def r14(spark, sf):
    return retrieval.neighbours(_run_hits(spark, sf).select("run_key", "chunk_id").distinct(), _chunks(spark, sf))


_SENT = r"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query("a1_sentences", f"with {S.CHUNKS} select chunk_id, (i - 1)::int sentence_no, s[i] sentence from (select chunk_id, s, unnest(range(1, len(s) + 1)) i from (select chunk_id, {_SENT} s from chunks where text is not null)) where length(s[i]) >= 30")
def a1(spark, sf):
    return answers.sentence_rows(_chunks(spark, sf))


def _top(spark, sf):
    return retrieval.diversified(retrieval.reranked(_queries(spark, sf), _chunks(spark, sf)), ["query_id"])


_SC = f"""{_RER}, dv as (select *, case when row_number() over (partition by query_id, doc_id order by rank) > 1 then 1 else 0 end late from rer), tp as (select query_id, chunk_id from (select query_id, chunk_id, row_number() over (partition by query_id order by late, rank) nr from dv) where nr <= 5),
se as (select chunk_id, i - 1 sentence_no, s[i] sentence from (select chunk_id, s, unnest(range(1, len(s) + 1)) i from (select chunk_id, {_SENT} s from chunks where text is not null)) where length(s[i]) >= 30),
ss as (select t.query_id, t.chunk_id, se.sentence_no, se.sentence, list_intersect(list_distinct(list_filter(regexp_extract_all(lower(q.query), '[a-z]{{2,}}'), lambda x: not list_contains({S.QSTOP}, x))), regexp_extract_all(lower(se.sentence), '[a-z]{{2,}}')) ts, len(ts) n from tp t join se using (chunk_id) join q using (query_id)),
sc as (select *, (case when n = 0 then 0.0 else n - case when length(sentence) > 320 then 1.5 else 0.0 end end)::double score from ss)"""


def _greedy(most: int) -> str:
    """The greedy choice unrolled: each step ranks what is left by what it adds to the picks before."""
    out = "cd as (select query_id, chunk_id, sentence_no::int sentence_no, score, ts from sc where score > 0), s0 as (select distinct query_id, []::varchar[] cov, []::varchar[] used, []::varchar[] taken from cd)"
    for k in range(1, most + 1):
        out += f""", g{k} as (select c.*, s.cov, s.used, s.taken, row_number() over (partition by c.query_id order by round(c.score + 0.9 * len(list_filter(c.ts, lambda x: not list_contains(s.cov, x))) - case when list_contains(s.used, c.chunk_id) then 2.0 else 0.0 end, 6) desc, c.chunk_id, c.sentence_no) rn
  from cd c join s{k - 1} s using (query_id) where not list_contains(s.taken, c.chunk_id || '#' || c.sentence_no)),
  s{k} as (select query_id, list_distinct(list_concat(cov, ts)) cov, list_append(used, chunk_id) used, list_append(taken, chunk_id || '#' || sentence_no) taken from g{k} where rn = 1)"""
    return out + ", ev as (" + " union all ".join(f"select query_id, {k}::int pick, chunk_id, sentence_no, score from g{k} where rn = 1" for k in range(1, most + 1)) + ")"


_EV = _SC + ", " + _greedy(4)


@query("a3_evidence", f"with {_EV} select * from ev where pick <= 4")
def a3(spark, sf):
    return answers.selected_evidence(answers.scored_sentences(_queries(spark, sf), _top(spark, sf), _chunks(spark, sf)))


@query("a5_abstentions", f"with {_EV}, g as (select query_id, max(score) m from ev where pick <= 4 group by 1), r as (select q.query_id, case when g.m is null then 'no_evidence' when g.m < 2 then 'weak_evidence' end reason from (select distinct query_id from q) q left join g using (query_id)) select query_id, reason is not null as abstain, reason from r")
def a5(spark, sf):
    ev = answers.selected_evidence(answers.scored_sentences(_queries(spark, sf), _top(spark, sf), _chunks(spark, sf)))
    return answers.abstentions(_queries(spark, sf), ev)


def _claims(spark, sf):
    from quire.functions import text as T

    runs = table(spark, sf, "answer_runs")
    c = nested.answer_table(runs, "run", ("result.answer",)).select(F.col("row_key").alias("run_key"), F.posexplode(T.sentences(F.col("`result.answer`"))).alias("claim_no", "claim")).distinct()
    f = nested.answer_table(runs, "run.result.evidence", ("sentence",)).select(F.col("parent_key").alias("run_key"), F.col("sentence").alias("fragment")).where("fragment is not null").distinct()
    return answers.aligned(c, f, "run_key")


_SURF = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_TERM = "list_distinct(list_filter(regexp_extract_all(" + _SURF + ", '[a-z0-9]{{3,}}'), lambda x: not list_contains([" + ",".join(f"'{w}'" for w in answers.CLAIM_STOPWORDS) + "], x)))"
_AL = _OUTPUTS + rf""", an as (select distinct run_id::varchar || '#' || result_pos run_key, json_extract_string(r, '$.answer') as text from results where json_type(r) = 'OBJECT'),
cl as (select run_key, i - 1 claim_no, s[i] claim from (select run_key, s, unnest(range(1, len(s) + 1)) i from (select run_key, {_SENT} s from an where text is not null))),
hd as (select run_id::varchar || '#' || result_pos run_key, json_extract(r, '$.evidence') h from results where json_type(r) = 'OBJECT'),
fr as (select distinct run_key, json_extract_string(h, '$[' || (u.i - 1) || '].sentence') fragment from hd, unnest(range(1, json_array_length(h)::bigint + 1)) u(i) where json_type(h) = 'ARRAY'),
cs as (select run_key, claim_no, {_SURF.format('claim')} cs, {_TERM.format('claim')} ct from cl), fs as (select run_key, {_SURF.format('fragment')} fs, {_TERM.format('fragment')} ft from fr where fragment is not null),
jj as (select c.run_key, c.claim_no, coalesce(cs <> '' and fs <> '' and contains(fs, cs), false) ex, case when fs is null or cs = '' or fs = '' or len(ct) = 0 then 0.0 else round(len(list_intersect(ct, ft)) / greatest(len(ct), 1), 3) end ov from cs c left join fs f using (run_key)),
lv as (select run_key, claim_no, case when ex then 3 when ov >= 0.72 then 2 when ov >= 0.4 then 1 else 0 end l, (case when ex then 1.0 else ov end)::double s from jj),
al as (select run_key, claim_no::int claim_no, ['unsupported', 'weak', 'fragment', 'exact'][l + 1] status, s score from (select *, row_number() over (partition by run_key, claim_no order by l desc, s desc) rn from lv) where rn = 1)"""


@query("a14_claim_alignment", _AL + " select * from al")
def a14(spark, sf):
    return _claims(spark, sf)


@query("a14_alignment_summary", _AL + " select *, round(supported / claims, 3) ratio, case when unsupported = 0 then 'pass' else 'needs_review' end verdict from (select run_key, count(*) claims, count(*) filter (status in ('exact', 'fragment')) supported, count(*) filter (status = 'weak') weak, count(*) filter (status = 'unsupported') unsupported from al group by 1)")
def a14_summary(spark, sf):
    return answers.alignment_summary(_claims(spark, sf), "run_key")


@query("a16_parse_status", r"""with r as (select distinct run_id, trim(coalesce(payload, '')) p from answer_runs) select run_id, case when p = '' then 'empty_output' when not json_valid(p) then 'invalid_json' when not regexp_matches(p, '^\s*\{') then 'json_not_object' else 'ok' end status from r""")
def a16(spark, sf):
    return table(spark, sf, "answer_runs").select("run_id", answers.parse_status(F.col("payload")).alias("status")).distinct()


_REL = _RH + ", hd as (select run_id::varchar || '#' || result_pos run_key, json_extract(r, '$.evidence') h from results where json_type(r) = 'OBJECT'), rl as (select distinct run_key, json_extract_string(h, '$[' || (u.i - 1) || '].chunk_id') item from hd, unnest(range(1, json_array_length(h)::bigint + 1)) u(i) where json_type(h) = 'ARRAY'), rel as (select * from rl where item is not null)"


@query("m1_ranking_metrics", _REL + """, g as (select h.run_key, count(*) filter (hit_pos < 5) n, count(*) filter (hit_pos < 5 and r.item is not null) hit, min(case when r.item is not null then hit_pos + 1 end) f from rh h left join rel r on h.run_key = r.run_key and h.chunk_id = r.item group by 1), nr as (select run_key, count(*) n_rel from rel group by 1)
  select coalesce(g.run_key, nr.run_key) run_key, coalesce(case when n > 0 then round(hit / n, 6) end, 0.0)::double as "precision", coalesce(case when n_rel > 0 then round(hit / n_rel, 6) end, 0.0)::double recall, coalesce(round(1.0 / f, 6), 0.0)::double reciprocal_rank from g full join nr on g.run_key = nr.run_key""")
def m1(spark, sf):
    hits = _run_hits(spark, sf).select("run_key", F.col("chunk_id").alias("item"), (F.col("hit_pos") + 1).alias("rank"))
    ev = nested.answer_table(table(spark, sf, "answer_runs"), "run.result.evidence", ("chunk_id",))
    rel = ev.select(F.col("parent_key").alias("run_key"), F.col("chunk_id").alias("item")).where("item is not null")
    return metrics.ranking_metrics(hits, rel, "run_key")


@query("m2_unique_docs", _RH + " select run_key, doc_id, (row_number() over (partition by run_key order by r, doc_id nulls first))::int doc_rank from (select run_key, doc_id, min(hit_pos) r from rh group by 1, 2)")
def m2(spark, sf):
    return metrics.unique_docs(_run_hits(spark, sf).withColumnRenamed("hit_pos", "rank"), "run_key")


_FOLD = "lower(replace(replace({}, 'ﬁ', 'fi'), 'ﬂ', 'fl'))"
_PACK = "regexp_replace(" + _FOLD + r", '[^\p{{L}}\p{{N}}]', '', 'g')"
_COVK = f"cov as (select case_id, len(h)::int matched, (case when len(kw) > 0 then round(len(h) / len(kw), 6) else 0.0 end)::double coverage from (select case_id, kw, list_filter(kw, lambda k: contains({_FOLD.format('t')}, {_FOLD.format('k')}) or contains({_PACK.format('t')}, {_PACK.format('k')})) h from (select case_id, coalesce(passage, '') t, coalesce(expected_keywords, {_NO}) kw from eval_cases)))"
_SL = f"{_COVK}, lb as (select case_id, unnest(list_distinct(list_filter(list_concat(['type:' || case_type, 'bucket:' || bucket, case when passage is null then 'negative' end], list_transform(coalesce(case_tags, {_NO}), lambda x: 'tag:' || x)), lambda x: x is not null))) slice from eval_cases), sl as (select slice, count(*) n_cases, round(avg(coverage), 6) mean_coverage from lb join cov using (case_id) group by 1)"


@query("m3_keyword_coverage", f"with {_COVK} select * from cov")
def m3(spark, sf):
    return metrics.keyword_coverage(table(spark, sf, "eval_cases"))


def _slices(spark, sf):
    cases = table(spark, sf, "eval_cases")
    return metrics.slices(cases, metrics.keyword_coverage(cases))


@query("m7_slices", f"with {_SL} select * from sl")
def m7(spark, sf):
    return _slices(spark, sf)


@query("m9_gates", f"with {_SL}, th(name, threshold) as (values ('type:overview', 0.75::double), ('tag:hard', 0.9::double), ('negative', 0.5::double), ('tag:absent', 0.5::double)) select name, threshold, mean_coverage actual, case when mean_coverage is null then 'missing' when mean_coverage >= threshold then 'pass' else 'fail' end verdict from th left join sl on th.name = sl.slice")
def m9(spark, sf):
    th = spark.createDataFrame([("type:overview", 0.75), ("tag:hard", 0.9), ("negative", 0.5), ("tag:absent", 0.5)], "name string, threshold double")
    return metrics.gates(_slices(spark, sf).select(F.col("slice").alias("name"), F.col("mean_coverage").alias("actual")), th)


@query("m10_latencies", "with l as (select effective_mode, processing_time_ms t from inspector_results where processing_time_ms is not null) select effective_mode, count(*) n, round(avg(t), 3) mean, median(t)::double as median, list_sort(list(t))[ceil(count(*) * 0.95)::bigint] p95 from l group by 1")
def m10(spark, sf):
    return metrics.latencies(table(spark, sf, "inspector_results"), "effective_mode", "processing_time_ms")


@query("m11_signal_counts", "select effective_mode, status, fallback_reason, count(*) n from inspector_results group by all")
def m11(spark, sf):
    return table(spark, sf, "inspector_results").groupBy("effective_mode", "status", "fallback_reason").agg(F.count(F.lit(1)).alias("n"))


_BK = f"""{S.HEADS}, bk as (select *, case when {S.any_of("x", ("scan", "capture", "ocr"))} then 'scan_like' when {S.any_of("x", ("form", "statement", "application", "questionnaire", "checklist", "appendix"))} then 'form_like' when page_count <= 2 then 'short_doc' when page_count >= 20 then 'long_doc' else 'medium_doc' end bucket from (select *, lower(coalesce(concat_ws(' ', source_pdf, document_type), '')) x from heads))"""
_DG = _BK + ", dg as (select bucket, count(*) n_docs, round(avg(structure_confidence), 6) mean_structure, round(avg(layout_confidence), 6) mean_layout, round(count(*) filter (title is null) / count(*), 6) untitled_rate, round(count(*) filter (structure_confidence < 0.5) / count(*), 6) weak_rate from bk group by 1)"


def _bucketed(spark, sf):
    return tables.heads(table(spark, sf, "doc_heads")).withColumn("bucket", metrics.corpus_bucket(F.concat_ws(" ", "source_pdf", "document_type"), F.col("page_count")))


@query("m12_corpus_buckets", f"with {_BK} select doc_id, bucket from bk")
def m12(spark, sf):
    return _bucketed(spark, sf).select("doc_id", "bucket")


@query("m13_round_robin_sample", f"with {_BK}, r as (select doc_id, bucket, row_number() over (partition by bucket order by page_count nulls first, doc_id) as round from bk) select doc_id, bucket, round::int as round from r order by round, bucket limit 24")
def m13(spark, sf):
    return metrics.round_robin(_bucketed(spark, sf), 24).select("doc_id", "bucket", "round")


@query("m13_sample_checksum", f"with {_BK}, r as (select doc_id, bucket, row_number() over (partition by bucket order by page_count nulls first, doc_id) as round from bk), s as (select doc_id from r order by round, bucket limit 24) select count(*) n, sha256(string_agg(doc_id, chr(10) order by doc_id)) digest from s")
def m13_checksum(spark, sf):
    return metrics.checksum(metrics.round_robin(_bucketed(spark, sf), 24), "doc_id")


@query("m14_bucket_diagnostics", f"with {_DG} select * from dg")
def m14(spark, sf):
    return metrics.bucket_diagnostics(_bucketed(spark, sf))


@query("m15_follow_ups", f"with {_DG} select bucket, case when untitled_rate > 0.2 then 'review_titles' when weak_rate > 0.3 then 'review_structure' when mean_layout < 0.5 then 'review_layout' else 'keep' end action from dg")
def m15(spark, sf):
    return metrics.follow_ups(metrics.bucket_diagnostics(_bucketed(spark, sf)))


_SNAP = "(select requested_mode, round(avg(confidence), 6) mean_confidence, count(*)::double n from inspector_results where status {} group by 1)"


@query("m17_snapshot_delta", f"""with a as {_SNAP.format("= 'ok'")}, b as {_SNAP.format("<> 'ok'")}, al as (select requested_mode, 'mean_confidence' metric, mean_confidence v from a union all select requested_mode, 'n', n from a), bl as (select requested_mode, 'mean_confidence' metric, mean_confidence v from b union all select requested_mode, 'n', n from b)
  select coalesce(al.requested_mode, bl.requested_mode) requested_mode, coalesce(al.metric, bl.metric) metric, al.v base, bl.v candidate, round(bl.v - al.v, 6) delta, coalesce(round(bl.v - al.v, 6) < 0, false) regressed from al full join bl on al.requested_mode = bl.requested_mode and al.metric = bl.metric""")
def m17(spark, sf):
    i = table(spark, sf, "inspector_results")
    snap = lambda c: i.where(c).groupBy("requested_mode").agg(F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count(F.lit(1)).cast("double").alias("n"))
    return metrics.snapshot_delta(snap("status = 'ok'"), snap("status <> 'ok'"), "requested_mode", ["mean_confidence", "n"])


@query("m20_worst_of", """with c as (select doc_id, case when status is null then 'skip' when status = 'ok' then 'pass' else 'fail' end s from inspector_results union all select doc_id, case when confidence is null then 'skip' when confidence < 0.4 then 'review' when confidence < 0.6 then 'warn' else 'pass' end from inspector_results)
  select doc_id, ['pass', 'skip', 'warn', 'review', 'fail'][max(list_position(['pass', 'skip', 'warn', 'review', 'fail'], s))] status from c group by 1""")
def m20(spark, sf):
    i = table(spark, sf, "inspector_results")
    a = i.select("doc_id", F.when(F.col("status").isNull(), "skip").when(F.col("status") == "ok", "pass").otherwise("fail").alias("status"))
    b = i.select("doc_id", F.when(F.col("confidence").isNull(), "skip").when(F.col("confidence") < 0.4, "review").when(F.col("confidence") < 0.6, "warn").otherwise("pass").alias("status"))
    return metrics.worst_of(a.unionByName(b), "doc_id")


@query("m22_page_coverage", f"with {S.CHUNKS}, {S.HEADS}, p as (select distinct doc_id, unnest(range(page_start, page_end + 1)) page from chunks where page_start <= page_end), g as (select doc_id, count(*) n_pages from p group by 1) select g.doc_id, n_pages, round(n_pages / page_count, 6) coverage from g join heads h on g.doc_id = h.doc_id")
def m22(spark, sf):
    p = _chunks(spark, sf).where("page_start <= page_end").select("doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page")).distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    return p.join(tables.heads(table(spark, sf, "doc_heads")).select("doc_id", "page_count"), "doc_id").select("doc_id", "n_pages", F.round(F.col("n_pages") / F.col("page_count"), 6).alias("coverage"))
