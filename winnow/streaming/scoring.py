"""Scoring of arriving rows against a static reference set, and windowed alert rates. An extension of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(arriving: DataFrame, screener, path: str, checkpoint: str, threshold: float = 0.5):
    """Start a query that appends (id, score, flagged) of each micro-batch under path; screener is a fitted one."""

    def score(batch: DataFrame, epoch: int) -> None:
        scored = screener.transform(batch).select("id", "score", (F.col("score") >= threshold).alias("flagged"))
        scored.write.mode("overwrite").parquet(f"{path}/batch={epoch}")  # a repeated batch writes the same folder

    return arriving.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)


def alert_rates(events: DataFrame, threshold: float, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Share of events (ts, event_type, value) at or over the threshold by tumbling window and type; works on streams and tables."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.avg((F.col("value") >= threshold).cast("double")).alias("alert_rate"), F.count("*").alias("n"))
