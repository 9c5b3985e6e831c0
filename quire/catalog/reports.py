"""Queries over reports, and round trips through sources and sinks."""

from pyspark.sql import functions as F

from quire.catalog import more  # noqa: F401  its SQL is built on below
from quire.catalog import sql as S
from quire.catalog.nested import _OUTPUTS
from quire.catalog.planning import _COV, _FAM, _heads, _pairs
from quire.catalog.retrieval import _BK, _DG, _bucketed
from quire.operators import diagnostics, metrics, nested, reports, semantics, tables
from quire.queries import ORACLES, query
from quire.session import cut_lineage, shared_folder, table
from quire.sources import readers, sinks


def _list_of(path: str) -> str:
    return f"""select run_id::varchar || '#' || result_pos run_key, json_extract(r, '{path}') h from results where json_type(r) = 'OBJECT'"""


def _values(name: str, path: str) -> str:
    return f"""{name}_h as ({_list_of(path)}), {name} as (select distinct run_key, json_extract_string(h, '$[' || (u.i - 1) || ']') as v from {name}_h, unnest(range(1, json_array_length(h)::bigint + 1)) u(i) where json_type(h) = 'ARRAY' and json_type(json_extract(h, '$[' || (u.i - 1) || ']')) not in ('OBJECT', 'ARRAY', 'NULL'))"""


_MATCHED = _values("mt", "$.answer_trace.matched_doc_ids")
_PAIRS = f"{_MATCHED}, pr as (select a.v first_doc, b.v second_doc from mt a join mt b on a.run_key = b.run_key and a.v < b.v group by 1, 2)"

ORACLES["d9_relations"] = f"""{_OUTPUTS}, {_PAIRS}, {_FAM}, {_COV}, d as (select f.doc_id, f.family, coalesce(h.document_type, '') dt, c.coverage_terms ct from fam f join heads h using (doc_id) join cov c using (doc_id)),
  j as (select first_doc, second_doc, a.family af, b.family bf, a.dt at_, b.dt bt, list_sort(list_intersect(a.ct, b.ct)) shared from pr join d a on a.doc_id = first_doc join d b on b.doc_id = second_doc)
  select first_doc, second_doc, case when af = bf and at_ = bt and len(shared) > 0 then 'overlap' when at_ = bt or len(shared) > 0 then 'complement' else 'diverge' end relation, shared[1:3] shared from j"""


def _differs(c: str, said: str) -> str:
    return f"case when a.{c} <> b.{c} and a.{c} not in ('general', 'other') and b.{c} not in ('general', 'other') then 'their {said} differ (' || replace(a.{c}, '_', ' ') || ' vs ' || replace(b.{c}, '_', ' ') || ')' end"


@query("d11_difference_summaries", f"""{_OUTPUTS}, {_PAIRS}, {_FAM}, dd as (select pv.doc_id, p purpose, s style, a audience, family from pv join fam using (doc_id)),
  x as (select first_doc, second_doc, list_filter([{_differs('purpose', 'purposes')}, {_differs('style', 'evidence styles')}, {_differs('audience', 'audiences')}, {_differs('family', 'families')}], lambda x: x is not null) parts from pr join dd a on a.doc_id = first_doc join dd b on b.doc_id = second_doc)
  select first_doc, second_doc, case when len(parts) > 0 then 'Both are relevant, but ' || array_to_string(parts, ' and ') || '.' end summary from x""")
def d11(spark, sf):
    return reports.difference_summaries(_pairs(spark, sf), _heads(spark, sf))


def _confidence(text: str, sfx: str) -> str:
    one = " union all ".join(f"select doc_id, '{f}' facet, '{v}' as value, {r} as rank, " + " + ".join(f"contains(t, '{h}')::int" for h in hints) + f" as n from ft{sfx}" for f, v, r, hints in semantics.FACETS)
    return f"""ft{sfx} as (select *, lower({text} || ' ' || array_to_string(coalesce(toc, []::varchar[]), ' ')) t from heads), fc{sfx} as ({one}), fa{sfx} as (select doc_id, n from (select *, row_number() over (partition by doc_id, facet order by n desc, rank) rn from fc{sfx}) where rn = 1),
  cf{sfx} as (select h.doc_id, least(0.95, round(0.35 + 0.15 * count(*) filter (n > 0) + 0.02 * least(sum(n), 5) + case when max(coalesce(len(h.toc), 0)) > 0 then 0.1 else 0 end, 6))::double c from heads h join fa{sfx} f on h.doc_id = f.doc_id group by 1)"""


@query("d6_second_pass", f"""with {S.HEADS}, {_confidence("coalesce(title, '')", "1")}, {_confidence("concat_ws(' ', title, source_pdf, replace(document_type, '_', ' '))", "2")} select doc_id, a.c as "first", b.c as "second", b.c > a.c accepted from cf1 a join cf2 b using (doc_id) where a.c < 0.62""")
def d6(spark, sf):
    return reports.second_pass(_heads(spark, sf))


@query("d12_labels", rf"""with {S.HEADS}, a as (select doc_id, trim(coalesce(title, '')) t, trim(regexp_replace(regexp_replace(doc_id, '-[0-9]{{4,}}$', ''), '-', ' ', 'g')) d from heads),
  b as (select *, case when t = '' then 'missing' when regexp_matches(t, '^[A-Za-z]*[-_ ]?[0-9]{{3,}}$') or not regexp_matches(t, '\p{{L}}{{3}}') then 'opaque' when length(t) > 120 then 'long' else 'good' end title_quality from a) select doc_id, title_quality, case when title_quality = 'good' then t else d end as label from b""")
def d12(spark, sf):
    return reports.labels(_heads(spark, sf))


@query("m16_corpus_checks", f"""with {_DG}, a as (select bucket, case when untitled_rate > 0.2 then 'review_titles' when weak_rate > 0.3 then 'review_structure' when mean_layout < 0.5 then 'review_layout' else 'keep' end act from dg),
  x as (select (select count(*) from dg) n, (select count(*) from dg where untitled_rate is null or weak_rate is null) bad, (select count(*) from dg where untitled_rate > 0.2 or weak_rate > 0.3 or coalesce(mean_layout < 0.5, false)) ov, (select count(*) from a) m, (select count(*) from a where act <> 'keep') todo)
  select 'buckets_present' as name, n > 0 passed from x union all select 'rates_present', bad = 0 from x union all select 'an_action_each', m = n from x union all select 'follow_ups_match', todo = ov from x""")
def m16(spark, sf):
    d = cut_lineage(metrics.bucket_diagnostics(_bucketed(spark, sf)))
    return reports.corpus_checks(d, metrics.follow_ups(d))


@query("m19_contract_status", f"""{_OUTPUTS}, {_MATCHED}, {_values("pm", "$.answer_trace.answer_contract.primary_doc_ids")}, eh as ({_list_of("$.evidence")}), ev as (select run_key, count(distinct u.i) n from eh, unnest(range(1, json_array_length(h)::bigint + 1)) u(i) where json_type(h) = 'ARRAY' and json_type(json_extract(h, '$[' || (u.i - 1) || ']')) <> 'NULL' group by 1),
  a as (select run_key, list(v) a from mt group by 1), b as (select run_key, list(v) b from pm group by 1), k as (select run_key from a union select run_key from b union select run_key from ev),
  j as (select k.run_key, coalesce(len(a), 0)::int n_matched, coalesce(len(b), 0)::int n_primary, coalesce(n, 0) n_evidence, len(list_filter(coalesce(b, []::varchar[]), lambda x: not list_contains(coalesce(a, []::varchar[]), x))) = 0 from_matched from k left join a using (run_key) left join b using (run_key) left join ev using (run_key))
  select *, n_evidence > 0 supported, case when n_primary = 0 then 'skip' when not from_matched then 'fail' when n_evidence = 0 then 'warn' else 'pass' end status from j""")
def m19(spark, sf):
    names = {n: f"run.result.{n}" for n in ("answer_trace.matched_doc_ids", "answer_trace.answer_contract.primary_doc_ids", "evidence")}
    runs = table(spark, sf, "answer_runs")
    docs = lambda n: nested.answer_table(runs, names[n], ("value",)).select(F.col("parent_key").alias("run_key"), "value")
    return reports.contract_status(docs("answer_trace.matched_doc_ids"), docs("answer_trace.answer_contract.primary_doc_ids"), docs("evidence").select("run_key"))


def _flags(spark, sf):
    return diagnostics.processing_flags(_heads(spark, sf), table(spark, sf, "doc_pages"), table(spark, sf, "inspector_results"))


_SAID = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in reports.MESSAGES.items()) + "}"


@query("m21_acceptance", f"with m as ({ORACLES['m18_processing_flags']}) select doc_id, case status when 'pass' then 'accept' when 'warn' then 'accept_with_notes' else 'needs_review' end verdict, array_to_string(list_transform(flags, lambda x: ({_SAID})[x]), ' ') messages from m")
def m21(spark, sf):
    return reports.acceptance(_flags(spark, sf))


_WEB = S.labels([("ocr_used", "coalesce(need, 0) > 0 or coalesce(used, 0) > 0"), ("encoding_uncertain", "coalesce(enc, false)"), ("engine_disagreement", "coalesce(dis, 0) > 0"), ("tables_detected", "coalesce(tab, 0) > 0"), ("not_indexed", "coalesce(n, 0) = 0"), ("structure_uncertain", "coalesce(structure_confidence < 0.55, false)"), ("layout_uncertain", "coalesce(layout_confidence < 0.55, false)"), ("ocr_incomplete", "coalesce(need, 0) > coalesce(used, 0)")])


@query("m24_display_status", f"""with {S.HEADS}, p as (select doc_id, count(*) filter (needs_ocr) need, count(*) filter (ocr_used) used, count(*) filter (extraction_engine_disagreement) dis from (select distinct * from doc_pages) group by 1), i as (select doc_id, bool_or(has_encoding_issues) enc, max(coalesce(len(pages_with_tables), 0)) tab from inspector_results group by 1), c as (select doc_id, count(distinct chunk_id) n from chunk_records group by 1),
  f as (select h.doc_id, {_WEB} flags from heads h left join p using (doc_id) left join i using (doc_id) left join c using (doc_id))
  select doc_id, flags, case when list_contains(flags, 'not_indexed') then 'incomplete' when list_has_any(flags, ['encoding_uncertain', 'engine_disagreement', 'structure_uncertain', 'layout_uncertain', 'ocr_incomplete']) then 'review' else 'ready' end status from f""")
def m24(spark, sf):
    return reports.ui_status(_heads(spark, sf), table(spark, sf, "doc_pages"), table(spark, sf, "inspector_results"), table(spark, sf, "chunk_records"))


_BAD = S.labels([("pages", "last_page is null"), ("page_count", "coalesce(last_page >= page_count, true)"), ("blocks", "coalesce(n_blocks, 0) = 0"), ("text", "coalesce(n_full, 0) * 2 < coalesce(n_blocks, 0)"), ("chunks", "coalesce(n_chunks, 0) = 0"), ("section_titles", "coalesce(n_titled, 0) = 0"), ("ranges_and_links", "coalesce(n_back, 0) + coalesce(n_self, 0) > 0")])


@query("m26_sanity", f"""with {S.HEADS}, {S.BLOCKS}, {S.CHUNKS}, p as (select doc_id, max(page_num) last_page from doc_pages group by 1), b as (select doc_id, count(*) n_blocks, count(*) filter (length(trim(text)) > 0) n_full from blocks group by 1),
  c as (select doc_id, count(*) n_chunks, count(section_title) n_titled, count(*) filter (page_end < page_start) n_back, count(*) filter (preceding_chunk_id = chunk_id or following_chunk_id = chunk_id) n_self from chunks group by 1)
  select doc_id, failed, len(failed) = 0 all_pass from (select h.doc_id, {_BAD} failed from heads h left join p using (doc_id) left join b using (doc_id) left join c using (doc_id))""")
def m26(spark, sf):
    return reports.sanity(_heads(spark, sf), table(spark, sf, "doc_pages"), tables.blocks(table(spark, sf, "page_blocks")), tables.chunks(table(spark, sf, "chunk_records")))


@query("m27_release_gates", f"""with {S.HEADS}, g as (select 'titled' gate, round(avg((title is not null)::int), 6)::double as value, 0.8::double threshold from heads union all select 'structure', round(avg(structure_confidence), 6), 0.6 from heads union all select 'layout', round(avg(layout_confidence), 6), 0.6 from heads union all select 'reviewed', null, 0.5),
  s as (select *, case when value is null then 'skip' when value >= threshold then 'pass' else 'fail' end status from g) select * from s union all select 'release', round(count(*) filter (status = 'pass') / nullif(count(*) filter (status <> 'skip'), 0), 6), 1.0, case when count(*) filter (status = 'fail') = 0 then 'pass' else 'fail' end from s""")
def m27(spark, sf):
    return reports.gate_table(_heads(spark, sf), [("titled", F.avg(F.col("title").isNotNull().cast("int")), 0.8), ("structure", F.avg("structure_confidence"), 0.6), ("layout", F.avg("layout_confidence"), 0.6), ("reviewed", F.max(F.lit(None).cast("double")), 0.5)])


# --- sources and sinks: written to the shared folder and read again -----------------


@query("s9_inventory", f"with {S.HEADS} select doc_id, title, page_count, coalesce(toc, []::varchar[]) toc from heads where page_count is null or page_count % 5 <> 0")
def s9(spark, sf):
    """Document records as JSON lines, those of every fifth page count broken off; the readable ones come back."""
    h = _heads(spark, sf).select("doc_id", "title", "page_count", "toc")
    line = F.to_json(F.struct("*"))
    at = shared_folder(spark, "inventory")
    h.select(F.when(F.coalesce(F.col("page_count") % 5 == 0, F.lit(False)), F.expr("left(to_json(struct(*)), length(to_json(struct(*))) - 3)")).otherwise(line).alias("value")).write.text(at)
    good, _ = readers.read_json_records(spark, at, h.schema, multi_line=False)
    return good.select("doc_id", "title", "page_count", F.coalesce("toc", F.array().cast("array<string>")).alias("toc"))


@query("s11_corpus_csv", f"with {S.HEADS} select sha256(doc_id) digest, source_pdf pdf_path, page_count pages, title creator_tool from heads where page_count is not null and source_pdf is not null and title is not null and regexp_full_match(title || source_pdf, '[\\x{{00}}-\\x{{FF}}]*')")
def s11(spark, sf):
    """Corpus entries as a Latin-1 CSV, with rows that lack a page count; the valid ones come back."""
    h = _heads(spark, sf).where("source_pdf is not null and title is not null").where(F.concat("title", "source_pdf").rlike(r"\A[\x00-\xFF]*\z"))
    at = shared_folder(spark, "corpus")
    h.select(F.sha2("doc_id", 256).alias("digest"), F.col("source_pdf").alias("pdf_path"), F.coalesce(F.col("page_count").cast("string"), F.lit("unknown")).alias("pages"), F.col("title").alias("creator_tool")).write.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').csv(at)
    return readers.read_corpus_csv(spark, at).select("digest", "pdf_path", "pages", "creator_tool")


@query("s12_cases", "select case_id, query, coalesce(expected_keywords, []::varchar[]) expected_keywords, coalesce(case_tags, []::varchar[]) case_tags from eval_cases")
def s12(spark, sf):
    at = shared_folder(spark, "cases")
    table(spark, sf, "eval_cases").write.json(at)
    return readers.read_cases(spark, at, multi_line=False).select("case_id", "query", "expected_keywords", "case_tags")


@query("s13_index_manifest", f"with {S.CHUNKS} select count(*) n_chunks, count(distinct doc_id) n_docs, 384::int dim from chunks where trim(concat_ws(' ', section_title, array_to_string(section_path, ' '), array_to_string(content_hints, ' '), text), ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def s13(spark, sf):
    """The index written twice over: first half of its documents by bucket, then all; nothing is left over or doubled."""
    ch = cut_lineage(tables.chunks(table(spark, sf, "chunk_records")))
    at = shared_folder(spark, "index")
    sinks.write_index(ch.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), at)
    return sinks.write_index(ch, at)


@query("s18_csv_report", f"with {_BK} select bucket, count(*) n_docs from bk group by 1")
def s18(spark, sf):
    at = shared_folder(spark, "report")
    sinks.write_csv(_bucketed(spark, sf).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_docs")), at)
    return spark.read.option("header", True).schema("bucket string, n_docs bigint").csv(at)
