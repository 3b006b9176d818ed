"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_entries(entries: DataFrame, key: str = "key", at: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once, however many runs bring it; keys are remembered for
    ``late`` after the newest entry."""
    return entries.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def outcome_counts(events: DataFrame, source: str, failed: str, at: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Outcomes by source and window: an extension, as runs have no windows."""
    return (
        events.withWatermark(at, late)
        .groupBy(F.window(at, width).alias("window"), source)
        .agg(F.count("*").alias("outcomes"), F.count_if(F.expr(failed)).alias("failures"))
    )


def append_batches(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to a table, each batch under its own id, so a batch
    that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
