"""Operators inside chunks and pages, plans and contexts, reports: small cases, odd rows, empty tables."""

from pyspark.sql import functions as F

from quire.operators import chunks as C
from quire.operators import context, inline, planning, reports, retrieval
from quire.operators.joins import BITMAP_BITS, in_bitmap, key_bitmap

BLOCKS = "block_id string, doc_id string, page_num int, text string, reading_order_index int, block_kind string, block_role string, extra int"
CHUNKS = "chunk_id string, doc_id string, text string, section_title string, section_path array<string>, chunk_strategy string, page_start int, content_hints array<string>, noise_labels array<string>, quality_score double, preceding_chunk_id string, following_chunk_id string, extra int"


def chunk(i, text, doc="d", title=None, strategy=None, hints=None, labels=None, quality=None, before=None, after=None, page=1, path=None):
    return (i, doc, text, title, path, strategy, page, hints, labels, quality, before, after, 1)


def test_tables_on_a_page(spark):
    words = " ".join(f"word{i}" for i in range(20))
    rows = [("a", "d", 0, words, 0, "table_like", None, 1), ("b", "d", 0, words + " more", 1, None, "table_like", 1), ("c", "d", 0, "nothing shared here", 2, "table_like", None, 1), ("p", "d", 0, "about word1 and word2", 3, "text", None, 1), ("q", "d", 0, "about word1", 4, None, None, 1), ("n", "d", 0, None, 5, "table_like", None, 1), ("o", "d", 1, words, 0, "table_like", None, 1), ("x", None, None, words, 0, "table_like", None, 1)]
    df = spark.createDataFrame(rows, BLOCKS)
    assert [tuple(r) for r in inline.overlapping_tables(df).collect()] == [("d", "b", "a")]
    got = {r["block_id"]: (r["after_id"], r["n_shared"]) for r in inline.table_places(df).collect()}
    assert got == {"a": ("p", 2), "b": ("p", 2), "c": (None, 0), "o": (None, 0)}
    assert inline.table_places(df.limit(0)).count() == 0 and inline.overlapping_tables(df.limit(0)).count() == 0


def test_inside_a_chunk(spark):
    rows = [chunk("a", "GENERAL RULES\n\nName: Bob. Office: north wing\n\nA sentence that is long enough to say something here.", path=["Root"]), chunk("b", "SAFETY NOTE: wear gloves"), chunk("n", None), chunk("e", ""), chunk("s", "Agenda\n- pump\n- valve", strategy="presentation_slide"), chunk("t", "Only a title", strategy="presentation_slide")]
    df = spark.createDataFrame(rows, CHUNKS)
    seg = sorted((r["chunk_id"], r["segment_no"], r["heading"], r["body"]) for r in inline.inline_segments(df).where("chunk_id = 'a'").collect())
    assert [x[2] for x in seg] == [None, "Name", "Office"] and seg[1][3] == "Bob."
    assert {(r["chunk_id"], r["line"]) for r in inline.header_lines(df).collect()} >= {("a", "GENERAL RULES")}
    labels = df.select("chunk_id", inline.inline_label(F.col("text")).alias("l")).where("l is not null").collect()
    assert [tuple(r) for r in labels] == [("b", "SAFETY NOTE")]
    sec = {r["para_no"]: (r["section"], r["path"], r["kind"]) for r in inline.inline_sections(df).where("chunk_id = 'a'").collect()}
    assert sec[2] == ("GENERAL RULES", "Root > GENERAL RULES", "report_section")
    assert {r["chunk_id"]: r["role"] for r in inline.slide_roles(df).collect()} == {"s": "agenda", "t": "title_slide"}
    assert [(r["subtopic"], sorted(r["cues"])) for r in inline.subtopics(df).collect()] == [("equipment", ["pump", "valve"])]
    for f in (inline.inline_segments, inline.header_lines, inline.inline_sections, inline.slide_roles, inline.subtopics):
        assert f(df.limit(0)).count() == 0


def test_packing_equals_brute_force(spark):
    text = " ".join(f"Sentence number {i} {'long ' * (i % 90)}ends." for i in range(60))
    got = spark.createDataFrame([(text,)], "text string").select(C.packed_sentences(F.col("text"))).first()[0]
    want, cur = [], ""
    for s in (x.strip() + "." for x in text.split(". ")):
        s = s.rstrip(".") + "."
        if cur and len(cur) + 1 + len(s) <= 650:
            cur += " " + s
        else:
            want += [cur] if cur else []
            cur = s
    assert got == [*want, cur]


def test_plans_and_sources(spark):
    q = spark.createDataFrame([("r", "Where is the pump manual?"), ("c", "Compare the pump and the valve"), ("f", "Fill in the parcel signature"), ("n", None), ("e", "")], "query_id string, query string")
    h = spark.createDataFrame([("m", "Pump Manual of the Northern Works", ["valve"], None, None, None, 1), ("o", None, None, None, None, None, 2)], "doc_id string, title string, toc array<string>, document_type string, source_pdf string, page_count int, extra int")
    p = {r["query_id"]: r for r in context.plans(q, planning.shortlist(q, h)).collect()}
    assert (p["r"]["class"], p["r"]["mode"], p["r"]["doc_ids"]) == ("document_query", "document_routing", ["m"])
    assert p["c"]["fallback"] and p["c"]["mode"] == "grounded_evidence"
    assert p["f"]["class"] == "structured_form" and p["n"]["class"] == p["e"]["class"] == "evidence_lookup"
    plan = context.plans(q, planning.shortlist(q, h))
    s = {r["query_id"]: (r["preferred_doc"], r["matching_docs"]) for r in context.sources(plan, planning.anchors(q, h)).collect()}
    assert s["r"] == (None, ["m"]) and s["n"] == (None, [])
    a = {r["query_id"]: r["answer"] for r in context.mode_answers(plan, h).collect()}
    assert a == {"r": "See Pump Manual of the Northern Works."}
    assert context.preferences(q, ).count() == 5 and context.plans(q.limit(0), planning.shortlist(q, h)).count() == 0


def test_contexts_of_hits(spark):
    rows = [chunk("a", "the pump of the boiler room stands here and there", after="b", hints=["procedural_like"]), chunk("b", "a pump handle is described in this sentence", before="a", after="c"), chunk("c", "junk", quality=0.01, before="b"), chunk("z", "pump of another document stands here", doc="other"), chunk("n", None, doc="other")]
    ch = spark.createDataFrame(rows, CHUNKS)
    q = spark.createDataFrame([("q", "the pump in the boiler room"), ("n", None)], "query_id string, query string")
    hits = spark.createDataFrame([("q", "a")], "query_id string, chunk_id string")
    got = [(r["chunk_id"], r["hop"]) for r in context.reranked_context(q, hits, ch).orderBy("expanded_context_rank").collect()]
    assert got == [("a", 0), ("b", 1)]
    ranked = retrieval.reranked(q, ch)
    short = spark.createDataFrame([("q", "other", 1.0, ["pump"], 1)], "query_id string, doc_id string, score double, matched array<string>, rank int")
    assert [(r["doc_id"], r["chunk_id"]) for r in context.backfilled(ranked.where("doc_id = 'd'"), q, short, ch).collect()] == [("other", "z")]
    assert context.backfilled(ranked, q, short, ch).count() == 0
    assert {r["chunk_id"]: r["metadata_signal"] for r in ranked.collect()}["a"] == 0.5


def test_reports_over_odd_rows(spark):
    h = spark.createDataFrame([("a-b-0001", "  ", None, None, None, None, None, None), ("c", "scan 00123", ["x"], "court", "court-order.pdf", 3, 0.4, None), ("d", "A fine title", None, None, None, 2, 0.9, 0.9)], "doc_id string, title string, toc array<string>, document_type string, source_pdf string, page_count int, structure_confidence double, layout_confidence double")
    assert {r["doc_id"]: (r["title_quality"], r["label"]) for r in reports.labels(h).collect()} == {"a-b-0001": ("missing", "a b"), "c": ("opaque", "c"), "d": ("good", "A fine title")}
    assert {r["doc_id"]: r["accepted"] for r in reports.second_pass(h).collect()}["c"]
    docs = spark.createDataFrame([("k", "x"), ("k", "x"), ("m", "y"), ("m", None)], "run_key string, value string")
    prim = spark.createDataFrame([("k", "x"), ("m", "z"), ("w", None)], "run_key string, value string")
    st = {r["run_key"]: r["status"] for r in reports.contract_status(docs, prim, spark.createDataFrame([("k",), ("o",)], "run_key string")).collect()}
    assert st == {"k": "pass", "m": "fail", "o": "skip"}
    g = {r["gate"]: r["status"] for r in reports.gate_table(h, [("one", F.avg("structure_confidence"), 0.9), ("none", F.max(F.lit(None).cast("double")), 1)]).collect()}
    assert g == {"one": "fail", "none": "skip", "release": "fail"}
    pages = spark.createDataFrame([("c", 0, True, False, None), ("c", 0, True, False, None), ("d", 0, None, None, None)], "doc_id string, page_num int, needs_ocr boolean, ocr_used boolean, extraction_engine_disagreement boolean")
    ins = spark.createDataFrame([("d", True, [1])], "doc_id string, has_encoding_issues boolean, pages_with_tables array<int>")
    ch = spark.createDataFrame([chunk("1", "t", doc="d"), chunk("1", "t", doc="d")], CHUNKS)
    ui = {r["doc_id"]: (r["flags"], r["status"]) for r in reports.ui_status(h, pages, ins, ch).collect()}
    assert ui["d"] == (["encoding_uncertain", "tables_detected"], "review") and ui["c"][1] == "incomplete" and "ocr_incomplete" in ui["c"][0]
    assert reports.ui_status(h.limit(0), pages, ins, ch).count() == 0


def test_bitmap_never_shuts_a_key_out(spark):
    import numpy as np

    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(-(2**62), 2**62, 2**55 + 12345)]
    bits = np.unpackbits(np.frombuffer(key_bitmap(spark.createDataFrame([(k,) for k in keys] + [(None,)], "h long"), "h"), np.uint8), bitorder="little")
    assert len(bits) == 1 << BITMAP_BITS and in_bitmap(bits, np.array(keys, np.int64).view(np.uint64)).all() and bits.sum() <= len(keys)
