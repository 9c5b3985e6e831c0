"""Incremental ingest: deduplication of redeliveries, windowed counts of late data, document totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def deduplicated(stream: DataFrame, key: str = "block_id", time: str = "ingested_at", lateness: str = "30 days") -> DataFrame:
    """A stream of rows without redeliveries; keys older than ``lateness`` are forgotten."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """window_start, by, n, total: events per time window; events later than ``lateness`` are left out."""
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))  # a watermark needs a zoned timestamp
    g = stream.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), by, "n", "total")


def ingest(stream: DataFrame, transform, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write ``transform(batch)`` of every micro-batch as Parquet below ``path``; a batch done again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
