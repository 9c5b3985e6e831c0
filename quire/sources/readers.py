"""Readers with fixed schemas; what cannot be read is kept apart, never dropped silently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (("block_id", T.StringType()), ("doc_id", T.StringType()), ("page_num", T.IntegerType()), ("text", T.StringType()), ("bbox", T.ArrayType(T.DoubleType())), ("reading_order_index", T.IntegerType()), ("extraction_method", T.StringType()), ("block_kind", T.StringType()), ("block_role", T.StringType()), ("text_quality_score", T.DoubleType()), ("structural_flags", T.ArrayType(T.StringType())))]
)
CORPUS_SCHEMA = "digest string, pdf_path string, urlkey string, pages int, file_size bigint, creator_tool string, producer string"


def read_json_records(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good, unreadable) records of JSON files with a closed schema; unreadable ones keep their raw text."""
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    df = spark.read.schema(with_bad).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    return df.where("_corrupt_record is null").drop("_corrupt_record"), df.where("_corrupt_record is not null")


def read_corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    """Corpus entries of a CSV with a header, by pages and digest; rows without digest or with a page count that is no number are left out.

    A file that isn't UTF-8 is read as Latin-1.
    """
    read = lambda encoding: spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    raw = read("UTF-8")
    if raw.where(F.concat_ws(" ", *[F.col(f"`{c}`") for c in raw.columns]).contains("\ufffd")).limit(1).count():
        raw = read("ISO-8859-1")
    cols = {c.split()[0]: c.split()[1] for c in CORPUS_SCHEMA.split(", ")}
    picked = [F.expr(f"try_cast(`{c}` as {t})").alias(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in cols.items()]
    return raw.select(*picked).where("digest is not null and pages is not null").orderBy("pages", "digest")


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, length, head (first bytes as text), digest (SHA-256) of files; the content itself is not kept."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return f.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.decode(F.substring("content", 1, 5), "ISO-8859-1").alias("head"), F.sha2("content", 256).alias("digest"))


def verified(files: DataFrame, expected: DataFrame) -> DataFrame:
    """name, status: ok, changed or missing of files against expected digests (name, digest)."""
    j = expected.select("name", F.lower("digest").alias("want")).join(files.select("name", "digest"), "name", "left")
    return j.select("name", F.when(F.col("digest").isNull(), "missing").when(F.col("digest") == F.col("want"), "ok").otherwise("changed").alias("status"))


def read_cases(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Evaluation cases of a JSON list, or of JSON lines; missing lists are empty."""
    s = "case_id string, case_type string, query string, relevant_chunk_ids array<string>, relevant_doc_ids array<string>, expected_keywords array<string>, case_tags array<string>, notes string"
    df = spark.read.schema(s).option("multiLine", multi_line).json(path)
    none = F.array().cast("array<string>")
    return df.select(*[F.coalesce(c, none).alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes])
