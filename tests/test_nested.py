import json

from quire.operators import nested


def run(hits, **more):
    return {"command": "answer-query", "ok": True, "result": {"query": "q", "top_k_hits": hits, **more}}


def hits_of(spark, *payloads):
    df = spark.createDataFrame(list(enumerate(payloads)), "run_id bigint, payload string")
    return sorted((r["run_id"], r["result_pos"], r["hit_pos"], r["chunk_id"]) for r in nested.answer_hits(df).collect())


def test_envelopes_blanks_and_marks(spark):
    one = run([{"chunk_id": "a"}, None, {"chunk_id": None}, {"chunk_id": "b"}])
    want = [(0, "a"), (3, "b")]
    texts = [json.dumps(one), "﻿ " + json.dumps(one) + "\n", json.dumps(json.dumps(one)), json.dumps([one]), json.dumps({**one, "result": json.dumps(one["result"])})]
    got = hits_of(spark, *texts)
    for i in range(len(texts)):
        assert [(p, c) for r, _, p, c in got if r == i] == want
    assert hits_of(spark, json.dumps([{"error": 1}, one]))[0][:3] == (0, 1, 0)


def test_odd_payloads(spark):
    whole = json.dumps(run([{"chunk_id": "a"}]))
    assert hits_of(spark, None, "", "{", whole[:-1], "7", '"x"', "[]", "NaN", json.dumps(run(None)), json.dumps(run("missing"))) == []
    assert hits_of(spark, json.dumps(run({"chunk_id": "solo"}))) == [(0, 0, 0, "solo")]
    assert hits_of(spark, json.dumps(run([], answer_trace={"previous": {"result": {"top_k_hits": [{"chunk_id": "no"}]}}}))) == []
    assert hits_of(spark, json.dumps(run([{"chunk_id": 5}]))) == [(0, 0, 0, "5")]


def test_received_twice_counts_once(spark):
    df = spark.createDataFrame([(1, json.dumps(run([{"chunk_id": "a"}])))] * 2, "run_id bigint, payload string")
    assert nested.answer_hits(df).count() == 1
    assert nested.answer_hits(df.limit(0)).count() == 0


def test_merged_types_and_links(spark):
    rows = [(1, json.dumps(run([{"chunk_id": "a", "q": 1, "row_key": "x", "labels": ["n", "m"]}]))), (2, json.dumps(run([{"chunk_id": "b", "q": 0.5, "deep": {"er": True}}])))]
    t = nested.answer_tables(spark.createDataFrame(rows, "run_id bigint, payload string"))
    hits = t["run.result.top_k_hits"]
    assert dict(hits.dtypes)["q"] == "double" and dict(hits.dtypes)["deep.er"] == "boolean" and "json_row_key" in hits.columns
    kids = t["run.result.top_k_hits.labels"]
    joined = kids.join(hits.select("row_key", "chunk_id").withColumnRenamed("row_key", "parent_key"), "parent_key")
    assert sorted((r["chunk_id"], r["ordinal"], r["value"]) for r in joined.collect()) == [("a", 0, "n"), ("a", 1, "m")]


def test_envelopes(spark):
    """Outputs as JSON strings inside objects, below errors, and in several lists of one payload; places count over the payload."""
    import json

    out = lambda c: {"result": {"top_k_hits": [{"chunk_id": c}]}}
    deep = out("d")
    for _ in range(12):
        deep = {"body": json.dumps(deep)} if _ % 2 else {"data": deep}
    rows = [(1, {"body": json.dumps(out("a"))}), (2, {"error": None, "data": out("b")}), (3, {"first": [out("c"), None, out("d")], "second": [out("e")]}), (4, deep), (5, {"error": "x", "data": {"top_k_hits": [{"chunk_id": "z"}]}}), (6, [[out("f"), out("g")], out("h")])]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows], "run_id bigint, payload string")
    got = sorted((r["run_id"], r["result_pos"], r["chunk_id"]) for r in nested.answer_hits(df).collect())
    assert got == [(1, 0, "a"), (2, 0, "b"), (3, 0, "c"), (3, 2, "d"), (3, 3, "e"), (4, 0, "d"), (6, 0, "f"), (6, 1, "g"), (6, 2, "h")]
