"""Churn kept up to date from a stream of commit events.

The model itself is bounded; this keeps one of its aggregates current.  Events are
(graph_id, commit_seq, path).  An event may come again; its first arrival counts,
as long as it repeats within the watermark's delay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_churn(events: DataFrame, time_col: str = "committed_at", delay: str = "7 days") -> DataFrame:
    """(graph_id, path, commits) as a streaming aggregate, for update or complete mode."""
    once = events.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["graph_id", "commit_seq", "path"])
    return once.groupBy("graph_id", "path").agg(F.count("*").alias("commits"))


def write_churn(events: DataFrame, table: str, checkpoint: str, time_col: str = "committed_at", delay: str = "7 days"):
    """Starts the query; every batch's changed counts are appended to ``table`` with the batch number."""

    def put(batch: DataFrame, number: int) -> None:
        # written under the batch's own name, so a batch that is run again replaces itself
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return running_churn(events, time_col, delay).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)


def current_churn(batches: DataFrame) -> DataFrame:
    """The latest count of each file from the written batches."""
    return batches.groupBy("graph_id", "path").agg(F.max_by("commits", "batch").alias("commits"))
