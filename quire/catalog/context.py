"""Queries over plans, sources and contexts."""

from pyspark.sql import functions as F

from quire.catalog import sql as S
from quire.catalog.chunks import _HINTS, _chunks
from quire.catalog.planning import _E, _FAM, _INTENT, _heads
from quire.catalog.retrieval import _ADM, _BON, _CAND, _GRAM, _HEUR, _NO, _Q, _QS, _RER, _STRUCT, _queries
from quire.operators import answers, context, planning, retrieval, semantics
from quire.operators import chunks as C
from quire.queries import query
from quire.session import cut_lineage

_FORM = "case " + " ".join(f"when list_has_any(regexp_extract_all(lower(coalesce(query, '')), '[a-z]+'), {list(ws)}) then '{n}'" for n, ws in context.FORM_INTENTS) + " end"
_HINTS_OF = {(f, v): h for f, v, _, h in semantics.FACETS}
_PREF = f"""pref as (select query_id, list_sort({S.labels([(n, S.any_of('l', tuple(w for c, vs in by.items() for v in vs for w in _HINTS_OF.get((c, v), ())))) for n, by in semantics.FAMILIES])}) families,
  list_sort({S.labels([(v, S.any_of('l', h)) for f, v, _, h in semantics.FACETS if f == 'purpose'])}) purposes from (select *, lower(coalesce(query, '')) l from q))"""
#: The shortlist of q9 over heads and q.
_SL = f"""tw as (select distinct doc_id, unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z]{{3,}}')) term from heads), cw as (select distinct doc_id, unnest(regexp_extract_all(lower(array_to_string({_E}, ' ')), '[a-z]{{3,}}')) term from heads),
  dw as (select doc_id, term, sum(w) w from (select *, 4.0::double w from tw union all select *, 2.5::double from cw) where not list_contains({S.STOP}, term) group by 1, 2), dfr as (select term, count(*) df from dw group by 1),
  sq as (select distinct query_id, unnest(regexp_extract_all(lower(query), '[a-z]{{2,}}')) term from q), sc as (select query_id, doc_id, round(sum(w + 4.0::double / df + case when df = 1 then 6.0 else 0.0 end), 6) score, count(*) n from sq join dfr using (term) join dw using (term) where not list_contains({S.QSTOP}, term) group by 1, 2),
  sl as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc) where rank <= 6)"""
_PLAN = f"""{_SL}, pi as (select query_id, {_INTENT} intent, {_FORM} form from (select *, lower(coalesce(query, '')) l from q)), ids as (select query_id, list(doc_id order by rank) ids from sl group by 1),
  p1 as (select *, case when intent in ('document_overview', 'document_routing', 'source_justification') then 1 when intent = 'cross_document_compare' then 3 when intent = 'source_listing' then 4 else 0 end most from pi left join ids using (query_id)),
  p2 as (select *, coalesce(ids, []::varchar[])[1:most] ds from p1), p3 as (select *, case when intent = 'cross_document_compare' then len(ds) < 2 else most > 0 and len(ds) = 0 end fallback from p2),
  p4 as (select *, case when most > 0 and not fallback then 'document_query' when form is not null then 'structured_form' else 'evidence_lookup' end as "class" from p3),
  plan as (select query_id, "class", intent, case "class" when 'document_query' then intent when 'structured_form' then 'structured_form' else 'grounded_evidence' end as mode, case when "class" = 'document_query' then ds else []::varchar[] end doc_ids, fallback from p4)"""
_H = f"{S.HEADS}, {_Q}"


def _short(spark, sf):
    return planning.shortlist(_queries(spark, sf), _heads(spark, sf))


def _plans(spark, sf):
    return context.plans(_queries(spark, sf), _short(spark, sf))


def _ranked(spark, sf):
    return retrieval.reranked(_queries(spark, sf), _chunks(spark, sf))


@query("d8_preferences", f"with {_Q}, {_PREF} select * from pref")
def d8(spark, sf):
    return context.preferences(_queries(spark, sf))


@query("q4_plans", f"with {_H}, {_PLAN} select * from plan")
def q4(spark, sf):
    return _plans(spark, sf)


@query("q6_form_intents", f"with {_Q} select query_id, {_FORM} form from q")
def q6(spark, sf):
    return _queries(spark, sf).select("query_id", context.form_intent(F.col("query")).alias("form"))


@query("q8_sources", f"""with {_H}, {_PLAN}, an as (select q.query_id, list_sort(list(distinct h.doc_id)) named from q join heads h on length(h.title) >= 12 and contains(lower(q.query), lower(h.title)) and regexp_matches(lower(h.title), '[a-z]{{3,}}') group by 1),
  m as (select p.query_id, intent, coalesce(named, doc_ids) ms from plan p left join an using (query_id)) select query_id, case when intent not in ('source_listing', 'cross_document_compare', 'document_routing') and len(ms) > 0 then ms[1] end preferred_doc, ms matching_docs from m""")
def q8(spark, sf):
    return context.sources(_plans(spark, sf), planning.anchors(_queries(spark, sf), _heads(spark, sf)))


@query("r7_lexical_bonus", f"""with {_RER}, k as (select *, list_distinct(terms) ts, regexp_extract_all(lower(text), '[a-z]{{2,}}') ws from j)
  select query_id, chunk_id, round(0.25 * len(list_intersect(ts, ws)) + 0.1 * len(list_filter(ts, lambda x: length(x) >= 4 and list_contains(list_transform(list_filter(ws, lambda y: length(y) >= 4), lambda y: substr(y, 1, 5)), substr(x, 1, 5)))) + 0.5 * round({_GRAM(4, 1.8)} + {_GRAM(3, 1.35)} + {_GRAM(2, 0.95)}, 6), 6)::double bonus from k""")
def r7(spark, sf):
    c = retrieval.candidates(_queries(spark, sf), _chunks(spark, sf)).join(_queries(spark, sf), "query_id").join(_chunks(spark, sf).select("chunk_id", "text"), "chunk_id")
    return c.select("query_id", "chunk_id", retrieval.lexical_bonus(F.col("query"), F.col("text")).alias("bonus"))


@query("r8_heuristic_bonus", f"with {_RER} select query_id, chunk_id, metadata_signal bonus from rer")
def r8(spark, sf):
    return _ranked(spark, sf).select("query_id", "chunk_id", F.col("metadata_signal").alias("bonus"))


@query("r15_intent_matches", f"with {_RER} select query_id, chunk_id from rer where metadata_signal > 0")
def r15(spark, sf):
    return _ranked(spark, sf).where("metadata_signal > 0").select("query_id", "chunk_id")


@query("r16_expanded_context", f"""with {_RER}, h as (select query_id, chunk_id from rer where rank <= 5), ok as (select chunk_id from adm where coalesce(quality_score, 1.0) >= 0.35),
  nb as (select query_id, chunk_id, min(hop)::int hop from (select *, 0 hop from h union all select h.query_id, c.preceding_chunk_id, 1 from h join chunks c using (chunk_id) where c.preceding_chunk_id in (select chunk_id from ok) union all select h.query_id, c.following_chunk_id, 1 from h join chunks c using (chunk_id) where c.following_chunk_id in (select chunk_id from ok)) group by 1, 2),
  j2 as (select n.query_id, n.chunk_id, n.hop, coalesce(s.n_shared, 0) n_shared, q.query, d.text, d.noise_labels, d.quality_score, d.content_hints, d.section_title, d.chunk_strategy, d.page_start, lower(coalesce(q.query, '')) l, concat_ws(' ', d.section_title, d.text) full_text,
    list_filter(regexp_extract_all(lower(q.query), '[a-z0-9]{{2,}}'), lambda x: not list_contains({S.QSTOP}, x)) w, list_filter(regexp_extract_all(lower(q.query), '[a-z]{{2,}}'), lambda x: not list_contains({S.QSTOP}, x)) terms
    from nb n join q using (query_id) join chunks d on n.chunk_id = d.chunk_id left join sh s on n.query_id = s.query_id and n.chunk_id = s.chunk_id),
  t2 as (select query_id, chunk_id, hop, round(({_QS})::double + round(0.35 * n_shared + round({_GRAM(4, 1.8)} + {_GRAM(3, 1.35)} + {_GRAM(2, 0.95)}, 6) + {_BON}, 6)::double + ({_STRUCT})::double + ({_HEUR})::double, 6) total from j2)
  select *, (row_number() over (partition by query_id order by total desc, chunk_id))::int expanded_context_rank from t2""")
def r16(spark, sf):
    hits = _ranked(spark, sf).where("rank <= 5").select("query_id", "chunk_id")
    return context.reranked_context(_queries(spark, sf), cut_lineage(hits), _chunks(spark, sf))


@query("v4_flat_metadata", rf"""with {S.CHUNKS}, t as (select chunk_id, text, regexp_extract_all(lower(text), '[a-z]{{4,}}') w from chunks where text is not null),
  u as (select chunk_id, w[i] term, i from (select chunk_id, w, unnest(range(1, len(w) + 1)) i from t)), f as (select chunk_id, term, min(i) i from u where not list_contains({S.STOP}, term) group by 1, 2),
  r as (select chunk_id, string_agg(term, '|' order by i) terms from (select *, row_number() over (partition by chunk_id order by i) rn from f) where rn <= 14 group by 1)
  select c.chunk_id, case when len(section_path) > 0 then array_to_string(section_path, '|') end section_path, coalesce(case when len(content_hints) > 0 then array_to_string(content_hints, '|') end, case when len(h) > 0 then array_to_string(h, '|') end) content_hints, case when len(noise_labels) > 0 then array_to_string(noise_labels, '|') end noise_labels, r.terms semantic_terms, text chunk_text
  from (select *, {_HINTS} h from chunks) c left join r on c.chunk_id = r.chunk_id""")
def v4(spark, sf):
    ch = _chunks(spark, sf)
    return context.flattened(ch, C.semantics(ch))


@query("v6_backfilled", f"""with {_RER}, {S.HEADS}, {_SL}, have as (select distinct query_id, doc_id from rer where rank <= 5), miss as (select query_id, doc_id from sl except select query_id, doc_id from have),
  b as (select m.query_id, m.doc_id, s.chunk_id, s.n_shared, row_number() over (partition by m.query_id, m.doc_id order by s.n_shared desc, s.chunk_id) r from miss m join sh s using (query_id) join chunks c on c.chunk_id = s.chunk_id and c.doc_id = m.doc_id) select query_id, doc_id, chunk_id, n_shared::int n_shared from b where r <= 2""")
def v6(spark, sf):
    return context.backfilled(_ranked(spark, sf), _queries(spark, sf), _short(spark, sf), _chunks(spark, sf))


@query("a8_ranked_documents", f"""with {_RER}, {_FAM}, {_SL}, {_PREF}, hb as (select query_id, doc_id, min(rank) hit from rer group by 1, 2),
  s as (select sl.query_id, sl.doc_id, round(3.0 * sl.n + case when len(families) = 0 then 0.0 when list_contains(families, family) then 4.0 else -2.5 end + case when hit is null then 0.0 else 3.0 - 0.4 * least(hit - 1, 6) end, 6)::double score from sl join pref using (query_id) left join fam using (doc_id) left join hb on sl.query_id = hb.query_id and sl.doc_id = hb.doc_id)
  select *, (row_number() over (partition by query_id order by score desc, doc_id))::int place from s""")
def a8(spark, sf):
    return context.ranked_documents(_short(spark, sf), _ranked(spark, sf), context.preferences(_queries(spark, sf)), semantics.families(_heads(spark, sf)))


_SENTS = r"list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query("a10_support_sentences", f"""with {_RER}, st as (select chunk_id, doc_id, i - 1 sentence_no, s[i] sentence from (select chunk_id, doc_id, s, unnest(range(1, len(s) + 1)) i from (select chunk_id, doc_id, {_SENTS} s from chunks where text is not null)) where length(s[i]) >= 30),
  ss as (select r.query_id, st.*, len(list_intersect(list_distinct(list_filter(regexp_extract_all(lower(q.query), '[a-z]{{2,}}'), lambda x: not list_contains({S.QSTOP}, x))), regexp_extract_all(lower(st.sentence), '[a-z]{{2,}}'))) n from rer r join q using (query_id) join st on r.chunk_id = st.chunk_id where r.rank <= 5),
  sr as (select *, case when n = 0 then 0.0 else n - case when length(sentence) > 320 then 1.5 else 0.0 end end score from ss), tr as (select *, case when score > 0 then 1 else 2 end tier from sr), tb as (select *, min(tier) over (partition by query_id, doc_id) best from tr),
  pl as (select *, row_number() over (partition by query_id, doc_id order by score desc, chunk_id, sentence_no) place from tb where tier = best) select query_id, doc_id, place::int place, chunk_id, sentence_no::int sentence_no, tier from pl where place <= 2""")
def a10(spark, sf):
    ch = _chunks(spark, sf)
    hits = _ranked(spark, sf).where("rank <= 5").select("query_id", "chunk_id")
    return context.support_sentences(answers.scored_sentences(_queries(spark, sf), hits, ch), ch)


@query("a12_mode_answers", f"""with {_H}, {_PLAN}, d as (select query_id, mode, doc_ids[i] doc_id, i from (select *, unnest(range(1, len(doc_ids) + 1)) i from plan where "class" = 'document_query')),
  t as (select d.*, coalesce(nullif(trim(h.title), ''), h.doc_id) title from d join heads h using (doc_id)), g as (select query_id, mode, arg_min(title, i) f, string_agg(title, '; ' order by i) al from t group by 1, 2)
  select query_id, mode, case mode when 'document_routing' then 'See ' || f || '.' when 'source_justification' then 'This rests on ' || f || '.' when 'document_overview' then 'About ' || f || '.' when 'source_listing' then 'Sources: ' || al || '.' else 'Compared: ' || al || '.' end answer from g""")
def a12(spark, sf):
    return context.mode_answers(_plans(spark, sf), _heads(spark, sf))
