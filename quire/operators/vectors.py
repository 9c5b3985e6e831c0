"""Signed hashing embeddings and exact vector search in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that go to the workers at once.
BLOCK = 2_000


def hashed_cells(texts: DataFrame, key: str, dim: int = 384) -> DataFrame:
    """key, cell, weight: sparse cells of the L2-normalised signed hashing embedding of each text (SHA-256 of its words).

    A text without words has no cells. Sums are made per key and cell before the shuffle.
    """
    tok = F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")).alias("tok")
    h = texts.where("text is not null").select(key, tok).groupBy(key, "tok").count().select(key, F.sha2("tok", 256).alias("h"), "count")
    cell = F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") % dim
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    c = h.select(key, cell.cast("int").alias("cell"), (sign * F.col("count")).alias("w")).groupBy(key, "cell").agg(F.sum("w").alias("w")).where("w <> 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return c.select(key, "cell", (F.col("w") / norm).alias("weight"))


def retrieval_surface(chunks: DataFrame) -> DataFrame:
    """chunk_id, surface: title, path, hints and text on lines of their own, blank parts left out."""
    empty = F.array().cast("array<string>")
    parts = F.array("section_title", F.array_join(F.coalesce("section_path", empty), " > "), F.array_join(F.coalesce("content_hints", empty), " "), "text")
    return chunks.select("chunk_id", F.array_join(F.filter(parts, lambda x: x.isNotNull() & (F.trim(x) != "")), "\n").alias("surface"))


def top_by_cosine(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, similarity, rank: the k most similar rows for every query, exactly.

    Queries go out in blocks; each partition keeps its own k best of a query, so
    what is shuffled is k rows per query and partition. Ties go to the lower
    key; a query doesn't find itself. Null, empty and zero vectors find nothing.
    """
    v = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    schema = "query_id bigint, k bigint, similarity double"

    def of(ids: np.ndarray, q: np.ndarray):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pdf = pdf[[len(x) == q.shape[1] for x in pdf["v"]]]
                if not len(pdf):
                    continue
                m = np.stack(pdf["v"].to_numpy()).astype(np.float64)
                n = np.linalg.norm(m, axis=1)
                m, keys = m[n > 0] / n[n > 0, None], pdf["k"].to_numpy()[n > 0]
                order = np.argsort(keys, kind="stable")
                m, keys = m[order], keys[order]
                s = np.round(q @ m.T, 9)
                s[ids[:, None] == keys[None, :]] = -2
                top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                rows = np.repeat(np.arange(len(ids)), top.shape[1])
                out = pd.DataFrame({"query_id": ids[rows], "k": keys[top.ravel()], "similarity": s[rows, top.ravel()]})
                yield out[out["similarity"] > -2]

        return run

    parts, block = [], []

    def flush() -> None:
        if block:
            q = np.array([r[1] for r in block], np.float64)
            n = np.linalg.norm(q, axis=1)
            if (n > 0).any():
                parts.append(v.mapInPandas(of(np.array([r[0] for r in block])[n > 0], q[n > 0] / n[n > 0, None]), schema))
            block.clear()

    for r in queries.where(F.col(vector).isNotNull()).select(key, vector).toLocalIterator():
        if block and len(r[1]) != len(block[0][1]):
            flush()
        block.append((r[0], r[1]))
        if len(block) == BLOCK:
            flush()
    flush()
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, similarity double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "k")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("k").alias(key), F.round("similarity", 6).alias("similarity"), "rank")
