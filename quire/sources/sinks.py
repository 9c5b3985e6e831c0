"""Writers: replacement by document, vector tables with a manifest, CSV and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.vectors import hashed_cells, retrieval_surface


def bucketed(df: DataFrame, buckets: int = 256) -> DataFrame:
    """With ``doc_bucket``: documents hashed into a fixed number of folders."""
    return df.withColumn("doc_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))


def replace_documents(df: DataFrame, path: str, buckets: int = 256) -> None:
    """Write rows by document bucket and replace only the buckets that are written.

    ``df`` must hold all documents of each bucket it touches.
    """
    b = bucketed(df, buckets)
    b.repartition("doc_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_bucket").parquet(path)


def write_index(chunks: DataFrame, path: str, dim: int = 384) -> DataFrame:
    """Write sparse hashed vectors of the chunks and return the manifest (one row: chunks, documents, dim)."""
    s = retrieval_surface(chunks).withColumnRenamed("surface", "text")
    cells = hashed_cells(s, "chunk_id", dim).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("cell", "weight"))).alias("cells"))
    bucketed(chunks.select("chunk_id", "doc_id").join(cells, "chunk_id")).repartition("doc_bucket").write.mode("overwrite").partitionBy("doc_bucket").parquet(path)
    m = chunks.sparkSession.read.parquet(path)
    return m.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("doc_id").alias("n_docs"), F.lit(dim).alias("dim"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("overwrite").json(path)
