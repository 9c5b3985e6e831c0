import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators import tables
from quire.plans import pipeline
from quire.sources import readers, sinks
from quire.streaming import ingest


def test_json_records_keep_the_unreadable_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"block_id": "b", "doc_id": "d", "page_num": 1, "text": "x", "other": 5}))
    (tmp_path / "b.json").write_text("{ broken")
    good, bad = readers.read_json_records(spark, str(tmp_path), readers.BLOCK_SCHEMA)
    assert [r["block_id"] for r in good.collect()] == ["b"] and [r["_corrupt_record"] for r in bad.collect()] == ["{ broken"]


def test_corpus_csv_and_cases(spark, tmp_path):
    (tmp_path / "c.csv").write_text("digest,pages,producer\na,3,x\n,4,y\nb,many,z\n")
    assert [(r["digest"], r["pages"], r["file_size"]) for r in readers.read_corpus_csv(spark, str(tmp_path / "c.csv")).collect()] == [("a", 3, None)]
    (tmp_path / "k.json").write_text(json.dumps([{"case_id": "1", "query": "q"}]))
    assert readers.read_cases(spark, str(tmp_path / "k.json")).first()["case_tags"] == []


def test_binary_files_are_verified(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"other")
    f = readers.read_binary(spark, str(tmp_path), "*.pdf")
    good = {r["name"]: r["digest"] for r in f.collect()}
    want = spark.createDataFrame([("a.pdf", good["a.pdf"].upper()), ("b.pdf", "00"), ("c.pdf", "00")], "name string, digest string")
    assert {r["name"]: r["status"] for r in readers.verified(f, want).collect()} == {"a.pdf": "ok", "b.pdf": "changed", "c.pdf": "missing"}


def test_replacing_some_documents_leaves_the_others(spark, tmp_path):
    p = str(tmp_path / "t")
    rows = lambda v: spark.createDataFrame([(f"d{i}", v) for i in range(8)], "doc_id string, v int")
    sinks.replace_documents(rows(1), p, 4)
    some = sinks.bucketed(rows(2), 4).where("doc_bucket = 0").drop("doc_bucket")
    sinks.replace_documents(some, p, 4)
    got = spark.read.parquet(p)
    assert got.count() == 8 and got.where("v = 2").count() == some.count() > 0


def test_index_manifest(spark, tmp_path):
    c = spark.createDataFrame([("c1", "d", "one two", None, None, None), ("c2", "d", "three", "T", ["a"], ["h"])], "chunk_id string, doc_id string, text string, section_title string, section_path array<string>, content_hints array<string>")
    assert tuple(sinks.write_index(c, str(tmp_path / "i")).first()) == (2, 1, 384)


def test_stream_deduplicates_and_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/page_blocks.parquet").write.parquet(src)
    schema: T.StructType = spark.read.parquet(src).schema
    s = spark.readStream.schema(schema).parquet(src)
    q = ingest.ingest(ingest.deduplicated(s, lateness="20000 days"), lambda b: b.select("block_id", F.length("text").alias("n")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    assert q.exception() is None
    assert spark.read.parquet(str(tmp_path / "out")).count() == tables.blocks(spark.read.parquet(src)).count()
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.write.parquet(str(tmp_path / "ev"))
    w = ingest.windowed_counts(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "ev")), "ts", "event_type", lateness="20000 days")
    q = w.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) s from counts").first()["s"] == ev.count()


def test_pipeline_from_blocks_to_answers(spark):
    t = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
    s = pipeline.structured(t("page_blocks"), t("doc_heads"))
    assert s["sections"].count() == s["chunks"].count() > 0
    q = t("eval_cases").select(F.col("case_id").alias("query_id"), "query").limit(10)
    a = pipeline.answer_batch(q, t("chunk_records")).collect()
    assert len(a) == 10 and all(r["abstained"] == (r["answer"] == "") for r in a)
