"""Queries over document semantics, vectors and query plans. Queries to plan are the held-out cases' queries."""

from pyspark.sql import functions as F

from quire.catalog import sql as S
from quire.operators import nested, planning, semantics, tables, vectors
from quire.queries import query
from quire.session import table

_E = "coalesce(toc, []::varchar[])"
_FC = "fc as (" + " union all ".join(f"select doc_id, '{f}' facet, '{v}' as value, {r} as rank, " + " + ".join(f"contains(t, '{h}')::int" for h in hints) + " as n from ft" for f, v, r, hints in semantics.FACETS) + ")"
_F = f"""{S.HEADS}, ft as (select *, lower(coalesce(title, '') || ' ' || array_to_string({_E}, ' ')) t from heads), {_FC},
fac as (select doc_id, facet, case when n > 0 then value else 'general' end as value, n from (select *, row_number() over (partition by doc_id, facet order by n desc, rank) rn from fc) where rn = 1)"""
_CONF = f"""{_F}, k as (select doc_id, count(*) filter (value <> 'general') k, sum(n) n from fac group by 1),
sem as (select doc_id, least(0.95, round(0.35 + 0.15 * k + 0.02 * least(n, 5) + case when toc > 0 then 0.1 else 0 end, 6))::double confidence, k, len, toc from (select h.doc_id, coalesce(length(title), 0) len, coalesce(len(h.toc), 0) toc, k.k, k.n from heads h join k on h.doc_id = k.doc_id))"""
_SHORT = {"document_type": "dt", "purpose": "p", "audience": "a", "style": "s"}
_FAMILY = "case " + " ".join("when " + " or ".join(f"coalesce({_SHORT[c]} in ({', '.join(repr(v) for v in vs)}), false)" for c, vs in by.items()) + f" then '{name}'" for name, by in semantics.FAMILIES) + " else 'other' end"
_FAM = f"""{_F}, pv as (select h.doc_id, h.document_type dt, max(value) filter (facet = 'purpose') p, max(value) filter (facet = 'audience') a, max(value) filter (facet = 'style') s from heads h join fac on h.doc_id = fac.doc_id group by 1, 2),
fam as (select doc_id, dt, {_FAMILY} family from pv)"""
_COV = f"""cov as (select h.doc_id, coalesce(x.ts, []) coverage_terms from heads h left join (select doc_id, list(term order by i) ts from (select doc_id, term, i, row_number() over (partition by doc_id order by i) rn from (select doc_id, w[i] term, min(i) i from
  (select doc_id, w, unnest(range(1, len(w) + 1)) i from (select doc_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || array_to_string({_E}, ' ')), '[a-z]{{4,}}') w from heads)) where not list_contains({S.STOP}, w[i]) group by 1, 2)) where rn <= 8 group by 1) x on h.doc_id = x.doc_id)"""
_Q = "q as (select case_id query_id, query from eval_cases)"


def _heads(spark, sf):
    return tables.heads(table(spark, sf, "doc_heads"))


def _queries(spark, sf):
    return table(spark, sf, "eval_cases").select(F.col("case_id").alias("query_id"), "query")


@query("d1_facets", f"with {_F} select * from fac")
def d1(spark, sf):
    return semantics.facets(_heads(spark, sf))


@query("d3_semantic_confidence", f"with {_CONF} select doc_id, confidence, case when confidence >= 0.8 then 'high' when confidence >= 0.62 then 'medium' else 'low' end as label, {S.labels([('no_title', 'len = 0'), ('no_facet', 'k = 0'), ('no_contents', 'toc <= 0')])} warnings from sem")
def d3(spark, sf):
    return semantics.semantic_confidence(_heads(spark, sf))


@query("d4_families", f"with {_FAM} select doc_id, family from fam")
def d4(spark, sf):
    return semantics.families(_heads(spark, sf))


@query("d5_inventory_summaries", f"with {S.HEADS}, {_COV} select h.doc_id, c.coverage_terms, concat_ws('; ', title, replace(nullif(document_type, ''), '_', ' '), page_count::varchar || ' pages') inventory_summary from heads h join cov c on h.doc_id = c.doc_id")
def d5(spark, sf):
    return semantics.inventory_summaries(_heads(spark, sf))


@query("d7_resolved_types", f"with {_F} select h.doc_id, coalesce(nullif(trim(document_type), ''), f.value) document_type from heads h join fac f on h.doc_id = f.doc_id and facet = 'purpose'")
def d7(spark, sf):
    return semantics.resolved(_heads(spark, sf)).select("doc_id", "document_type")


def _pairs(spark, sf):
    return semantics.matched_pairs(nested.answer_table(table(spark, sf, "answer_runs"), "run.result.answer_trace.matched_doc_ids", ("value",)).select("parent_key", "value"))


@query("d9_relations")
def d9(spark, sf):
    return semantics.relations(_pairs(spark, sf), _heads(spark, sf))


@query("d10_assessments", f"""with {_CONF}, j as (select h.doc_id, (0.65 * s.confidence + coalesce(0.2 * h.structure_confidence, 0) + coalesce(0.15 * h.layout_confidence, 0)) / (0.65 + case when h.structure_confidence is not null then 0.2 else 0 end + case when h.layout_confidence is not null then 0.15 else 0 end)::double c from heads h join sem s on h.doc_id = s.doc_id),
  r as (select doc_id, least(0.95, round(c, 6))::double confidence from j) select doc_id, confidence, case when confidence >= 0.8 then 'trusted' when confidence >= 0.62 then 'usable' else 'verify' end trust from r""")
def d10(spark, sf):
    return semantics.assessments(_heads(spark, sf))


@query("v1_hashed_cells", rf"""with {S.CHUNKS}, t as (select chunk_id, unnest(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) tok from chunks where text is not null), c as (select chunk_id, tok, count(*) n, sha256(tok) h from t group by 1, 2),
  w as (select chunk_id, (('0x' || substr(h, 1, 8))::ubigint % 384)::int cell, sum(n * case when ('0x' || substr(h, 9, 2))::int % 2 = 0 then 1 else -1 end) w from c group by 1, 2)
  select chunk_id, cell, w / sqrt(sum(w * w) over (partition by chunk_id)) weight from w where w <> 0""")
def v1(spark, sf):
    return vectors.hashed_cells(tables.chunks(table(spark, sf, "chunk_records")), "chunk_id")


@query("v3_retrieval_surface", f"""with {S.CHUNKS} select chunk_id, array_to_string(list_filter([section_title, array_to_string(coalesce(section_path, []), ' > '), array_to_string(coalesce(content_hints, []), ' '), text], lambda x: x is not null and trim(x) <> ''), chr(10)) surface from chunks""")
def v3(spark, sf):
    return vectors.retrieval_surface(tables.chunks(table(spark, sf, "chunk_records")))


@query("v5_cosine_top5", """with v as (select vec_id, embedding::double[] e from embeddings where embedding is not null), s as (select q.vec_id query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) c from v q, v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id),
  r as (select *, row_number() over (partition by query_id order by c desc, vec_id) as rank from s) select query_id, vec_id, round(c, 6) similarity, rank::int as rank from r where rank <= 5""")
def v5(spark, sf):
    v = table(spark, sf, "embeddings")
    return vectors.top_by_cosine(v, v.where("vec_id % 100 = 0"))


@query("q1_query_terms", f"with {_Q} select query_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(query), '[a-z]{{2,}}'), lambda x: not list_contains({S.QSTOP}, x)))) terms from q where query is not null")
def q1(spark, sf):
    from quire.functions import text as T

    return _queries(spark, sf).where("query is not null").select("query_id", T.query_terms(F.col("query")).alias("terms"))


_CUES = ", ".join("(" + " or ".join(f"contains(lower(coalesce(query, '')), '{w}')" for w in ws) + f") as {c}" for c, ws in planning.CUES.items())


@query("q2_cues", f"with {_Q} select query_id, {_CUES} from q")
def q2(spark, sf):
    return planning.cues(_queries(spark, sf))


_MODES = ["grounded_evidence", *dict.fromkeys(m for m, _, _ in planning.MODE_RULES)]
_SCORES = " union all ".join(f"select query_id, '{m}' as mode, ({'0.5' if m == 'grounded_evidence' else '0.0'}" + "".join(f" + {c}::int * {w}" for mm, c, w in planning.MODE_RULES if mm == m) + ")::double as score from c" for m in _MODES)


@query("q3_answer_modes", f"with {_Q}, c as (select query_id, {_CUES} from q), s as ({_SCORES}) select query_id, mode, score from (select *, row_number() over (partition by query_id order by score desc, mode desc) rn from s) where rn = 1")
def q3(spark, sf):
    return planning.chosen_mode(planning.mode_scores(planning.cues(_queries(spark, sf))))


_INTENT = r"""case when regexp_matches(l, '\b(?:define|definition|what is|meaning)\b') then 'definition' when contains(l, 'compare') or contains(l, 'difference') or contains(l, 'versus') then 'cross_document_compare' when starts_with(l, 'which') then 'source_listing' when starts_with(l, 'where') then 'document_routing' when starts_with(l, 'why') then 'source_justification' when starts_with(l, 'what') or starts_with(l, 'how') then 'document_overview' else 'generic' end"""
_QI = f"{_Q}, qi as (select query_id, query, {_INTENT} intent from (select *, lower(coalesce(query, '')) l from q))"


@query("q5_intents", f"with {_QI} select query_id, intent from qi")
def q5(spark, sf):
    return _queries(spark, sf).select("query_id", planning.intent(F.col("query")).alias("intent"))


_POOL = "case intent " + " ".join(f"when '{n}' then greatest({m} * 5, {lo})" for n, (m, lo) in planning.POOLS.items()) + " else greatest(20, 15) end"


@query("q10_contracts", f"""with {_QI}, p as (select query_id, intent, case when intent in ('source_listing', 'cross_document_compare', 'document_routing', 'source_justification') then 'cross_document_discovery' when intent = 'document_overview' then 'document_understanding' else 'single_document_qa' end path from qi)
  select query_id, intent, path, {_POOL} pool_size, case intent when 'generic' then 1 when 'definition' then 0 else 2 end neighbor_depth, case when path = 'cross_document_discovery' then 1 else 2 end per_doc_limit from p""")
def q10(spark, sf):
    return planning.contracts(_queries(spark, sf))


@query("q11_augmented", f"with {_QI} select query_id, concat_ws(' ', query, case intent " + " ".join(f"when '{n}' then '{v}'" for n, v in planning.EXPANSIONS.items()) + " end) augmented from qi")
def q11(spark, sf):
    return planning.augmented(_queries(spark, sf))


@query("q7_title_anchors", f"with {S.HEADS}, {_Q} select distinct q.query_id, h.doc_id from q join heads h on length(h.title) >= 12 and contains(lower(q.query), lower(h.title)) and regexp_matches(lower(h.title), '[a-z]{{3,}}')")
def q7(spark, sf):
    return planning.anchors(_queries(spark, sf), _heads(spark, sf))


@query("q9_shortlist", f"""with {S.HEADS}, {_Q}, tw as (select distinct doc_id, unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z]{{3,}}')) term from heads), cw as (select distinct doc_id, unnest(regexp_extract_all(lower(array_to_string({_E}, ' ')), '[a-z]{{3,}}')) term from heads),
  d as (select doc_id, term, sum(w) w from (select *, 4.0::double w from tw union all select *, 2.5::double from cw) where not list_contains({S.STOP}, term) group by 1, 2), df as (select term, count(*) df from d group by 1),
  qt as (select distinct query_id, unnest(regexp_extract_all(lower(query), '[a-z]{{2,}}')) term from q), s as (select query_id, doc_id, round(sum(w + 4.0::double / df + case when df = 1 then 6.0 else 0.0 end), 6) score, list_sort(list(term)) matched from qt join df using (term) join d using (term) where not list_contains({S.QSTOP}, term) group by 1, 2),
  r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s) select query_id, doc_id, score, matched, rank::int as rank from r where rank <= 6""")
def q9(spark, sf):
    return planning.shortlist(_queries(spark, sf), _heads(spark, sf))
