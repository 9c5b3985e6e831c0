"""Base tables without redeliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last delivered row of each key. Rows with a null key part form one key; ties keep one row."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order))
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def blocks(df: DataFrame) -> DataFrame:
    return latest(df, ["block_id"], "ingested_at")


def chunks(df: DataFrame) -> DataFrame:
    return latest(df, ["chunk_id"], "written_at")


def heads(df: DataFrame) -> DataFrame:
    return latest(df, ["doc_id"], "registered_at")
