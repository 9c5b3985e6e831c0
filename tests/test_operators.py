"""Small cases of the core operators; whole-table agreement with SQL is in test_oracles."""

from pyspark.sql import functions as F

from quire.operators import answers, blocks, chunks, diagnostics, metrics, rendering, retrieval, sections, vectors

BLOCK = "doc_id string, page_num int, block_id string, reading_order_index int, bbox array<double>"


def test_reading_order_of_two_columns(spark):
    rows = [("d", 0, "r2", 0, [0.55, 0.3, 0.95, 0.4]), ("d", 0, "l2", 1, [0.05, 0.3, 0.45, 0.4]), ("d", 0, "r1", 2, [0.55, 0.1, 0.95, 0.2]), ("d", 0, "l1", 3, [0.05, 0.1, 0.45, 0.2]), ("d", 0, "top", 4, [0.05, 0.0, 0.95, 0.05])]
    got = blocks.reading_order(spark.createDataFrame(rows, BLOCK)).orderBy("position").collect()
    assert [r["block_id"] for r in got] == ["top", "l1", "l2", "r1", "r2"]


def test_reading_order_without_boxes_keeps_the_index(spark):
    rows = [("d", 0, "b", 1, None), ("d", 0, "a", 2, [0.0, 0.0, 1.0, 1.0]), ("d", 0, "c", 0, [0.0, 0.5, 1.0, 1.0])]
    assert [r["block_id"] for r in blocks.reading_order(spark.createDataFrame(rows, BLOCK)).orderBy("position").collect()] == ["c", "b", "a"]


def test_classifier_of_small_texts(spark):
    texts = [None, "", "- verify the lock", "Chapter 2 Safety", "Name: value", "Who asks?", "The table: a | b and column", "A long sentence that simply ends with a full stop after more than ten words."]
    got = blocks.classified(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "block_id string, text string")).orderBy("block_id").collect()
    assert [r["block_role"] for r in got] == ["unknown", "unknown", "checklist_item", "heading", "key_value", "paragraph", "table_like", "paragraph"]
    assert "empty" in got[0]["structural_flags"] and "question_like" in got[5]["structural_flags"]


def test_sections_and_parents(spark):
    rows = [(f"b{i}", "d", 0, i, t) for i, t in enumerate(["intro text without a heading at all, which ends here.", "1. Alpha", "body one ends here with a stop.", "1.1 Beta", "1.1.1 Gamma", "2. Delta"])]
    b = spark.createDataFrame(rows, "block_id string, doc_id string, page_num int, reading_order_index int, text string")
    heads = spark.createDataFrame([("d", None)], "doc_id string, toc array<string>")
    s = sections.section_table(sections.segmented(sections.headings(b, heads)))
    up = {r["section_no"]: r["parent_no"] for r in sections.parents(s).collect()}
    assert up == {0: None, 1: None, 2: 1, 3: 2, 4: None}
    path = {r["section_no"]: r["path"] for r in sections.paths(s, sections.parents(s)).collect()}
    assert path[3] == ["1. Alpha", "1.1 Beta", "1.1.1 Gamma"]


def test_packing_keeps_all_sentences(spark):
    text = " ".join(f"Sentence number {i} has some words in it." for i in range(40))
    got = spark.range(1).select(chunks.packed_sentences(F.lit(text), 200).alias("s")).first()["s"]
    assert " ".join(got) == text and max(map(len, got)) <= 200


def test_links_equal_lag_and_lead(spark):
    rows = [(f"c{i}", "d" if i < 5 else None, i // 2, i) for i in range(7)]
    n = chunks.numbered(spark.createDataFrame(rows, "chunk_id string, doc_id string, page_start int, reading_order_index int"))
    got = {r["chunk_id"]: (r["preceding_id"], r["following_id"]) for r in chunks.links(n.where("doc_id is not null")).collect()}
    assert got["c0"] == (None, "c1") and got["c4"] == ("c3", None)


def test_cosine_equals_brute_force_and_survives_odd_vectors(spark):
    import numpy as np

    rnd = np.random.default_rng(0)
    v = {i: rnd.normal(size=8).tolist() for i in range(60)}
    rows = [*v.items(), (60, None), (61, []), (62, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = vectors.top_by_cosine(df, df.where("vec_id in (3, 7, 62)"), 4).collect()
    for q in (3, 7):
        s = sorted(((-np.dot(v[q], x) / np.linalg.norm(v[q]) / np.linalg.norm(x), i) for i, x in v.items() if i != q))[:4]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [i for _, i in s]
    assert not [r for r in got if r["query_id"] == 62]


def test_diversified_fills_up(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 3)], "query_id string, doc_id string, rank int")
    got = retrieval.diversified(hits, ["query_id"], 3, 1).orderBy("new_rank").collect()
    assert [r["rank"] for r in got] == [1, 3, 2]


def test_parse_status(spark):
    texts = [None, "", "<think>x</think>", "{}", "```json\n{}\n```", "a ```{}```", "```py\n1\n```", "[1]", "{", "```{}``` ```{}```"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", answers.parse_status(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == ["empty_output", "empty_output", "empty_output", "ok", "ok", "text_outside_fence", "non_json_fence", "json_not_object", "invalid_json", "multiple_fenced_blocks"]


def test_ranking_metrics_divide_by_what_was_returned(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "z", 1)], "q string, item string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "c"), ("s", "x")], "q string, item string")
    got = {r["q"]: (r["precision"], r["recall"], r["reciprocal_rank"]) for r in metrics.ranking_metrics(hits, rel, "q").collect()}
    assert got == {"q": (0.5, 0.5, 0.5), "r": (0.0, 0.0, 0.0), "s": (0.0, 0.0, 0.0)}


def test_a_suite_counts_what_retrieval_misses(spark):
    cases = spark.createDataFrame([("good", "p", ["red", "lamp"]), ("late", "p", ["blue"]), ("miss", "red", ["red"]), ("neg", None, ["x"]), ("nohit", "p", ["red"])], "case_id string, passage string, expected_keywords array<string>")
    chunks = spark.createDataFrame([("c1", "A Red lamp."), ("c2", "A red shade."), ("c3", "blue"), ("c4", None)], "chunk_id string, text string")
    rel = metrics.keyword_relevance(cases, chunks)
    assert sorted(map(tuple, rel.collect())) == [("good", "c1"), ("late", "c3"), ("miss", "c1"), ("miss", "c2"), ("nohit", "c1"), ("nohit", "c2")]
    hits = spark.createDataFrame([("good", "c1", 1), ("late", "c1", 1), ("late", "c3", 2), ("miss", "c3", 1), ("neg", "c1", 1)], "case_id string, item string, rank int")
    said = spark.createDataFrame([("good", "A Red lamp."), ("late", "blue"), ("miss", "blue")], "case_id string, answer string")
    ab = spark.createDataFrame([("good", False), ("late", False), ("miss", False), ("neg", True), ("nohit", False)], "case_id string, abstain boolean")
    r = diagnostics.case_results(cases, hits, rel, said, ab)
    got = {x["case_id"]: (x["recall"], x["reciprocal_rank"], x["coverage"]) for x in r.collect()}
    assert got == {"good": (1.0, 1.0, 1.0), "late": (1.0, 0.5, 1.0), "miss": (0.0, 0.0, 0.0), "neg": (0.0, 0.0, 0.0), "nohit": (0.0, 0.0, 0.0)}
    status = diagnostics.case_status(r)
    assert {x["case_id"]: x["status"] for x in status.collect()} == {"good": "pass", "late": "retrieval_warning", "miss": "retrieval_warning", "neg": "pass", "nohit": "retrieval_warning"}
    s = diagnostics.suite_summary(r, status).first()
    assert (s["mean_recall"], s["mrr"], s["mean_coverage"], s["n_warnings"]) == (0.5, 0.375, 0.5, 3)


def test_every_upload_rule_can_reject(spark):
    rows = [("ok", "%PDF-1.7", 1000, 3), ("html", "<html>", 1000, 3), ("big", "%PDF-1.4", 10**12, 3), ("long", "%PDF-1.7", 1000, 21)]
    got = diagnostics.upload_rejections(spark.createDataFrame(rows, "name string, head string, length bigint, page_count int"), most_pages=20).collect()
    assert {r["name"]: r["reason"] for r in got} == {"html": "not_pdf", "big": "too_large", "long": "too_many_pages"}


def _answer(spark, query, rows, k):
    cols = "chunk_id string, doc_id string, text string, preceding_chunk_id string, following_chunk_id string"
    ch = spark.createDataFrame(rows, cols).withColumns({"section_title": F.lit(None).cast("string"), "noise_labels": F.array().cast("array<string>"), "content_hints": F.array().cast("array<string>"), "quality_score": F.lit(1.0)})
    return rendering.answered(spark.createDataFrame([("q", query)], "query_id string, query string"), ch, k).first()


def test_answers_keep_to_the_contract_they_report(spark):
    scattered = "A red box was put in the yard this morning. The old lamps are kept in another building."
    rows = [(f"c{i:02}", f"d{i:02}", scattered if i != 30 else "The red lamps were put in this building.", None, None) for i in range(41)]
    assert "d30" in _answer(spark, "Which red lamps", rows, 5)["sources"]  # pool of 40
    assert "d40" not in _answer(spark, "Which red lamps", [r if r[0] != "c30" else ("c40", *r[1:]) for r in rows[:40]] + [("c99", "d40", rows[30][2], None, None)], 5)["sources"]

    rows = [("a1", "a", "The red lamps stand in the northern hall.", None, None), ("a2", "a", "Some red lamps hang in the southern hall.", None, None), ("b1", "b", "A red door leads into the western hall.", None, None)]
    assert _answer(spark, "red lamps", rows, 2)["answer"] == f"{rows[0][2]} {rows[1][2]}"  # two of a document

    rows = [("n0", "n", "The red lamps stand in the northern hall.", None, "n1"), ("n1", "n", "Next come lamps of another shape and size.", "n0", "n2"), ("n2", "n", "Last come lamps that nobody has ever lit.", "n1", None)]
    said = [_answer(spark, q, rows, 1)["answer"] for q in ("define red lamps", "red lamps", "how red lamps")]
    assert said == [" ".join(r[2] for r in rows[:n]) for n in (1, 2, 3)]  # neighbours up to 0, 1 and 2 hops

    rows = [(f"e{i:02}", f"e{i:02}", scattered, None, None) for i in range(25)] + [("e99", "e99", "The word is defined here: red lamps means signals.", None, None)]
    assert _answer(spark, "define red lamps", rows, 1)["answer"] == rows[-1][2]  # searched with what the intent adds


def test_round_robin_takes_buckets_in_turn(spark):
    rows = [("a", i, f"a{i}") for i in range(5)] + [("b", 0, "b0")]
    got = metrics.round_robin(spark.createDataFrame(rows, "bucket string, page_count int, doc_id string"), 4).collect()
    assert [r["doc_id"] for r in got] == ["a0", "b0", "a1", "a2"]
