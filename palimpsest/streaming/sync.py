"""Incremental ingest: overlap windows, idempotent batches, durable checkpoints, file streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds that each run reads again before its checkpoint.
OVERLAP = 300


def overlap_batch(events: DataFrame, time: str, committed: str, until: str, overlap: int = OVERLAP) -> DataFrame:
    """Rows of a run: from the checkpoint less the overlap to ``until``."""
    low = F.lit(committed).cast("timestamp") - F.make_dt_interval(secs=F.lit(overlap))
    return events.where((F.col(time) >= low) & (F.col(time) <= F.lit(until).cast("timestamp")))


def enqueue(jobs: DataFrame, offered: DataFrame, keys: list[str]) -> DataFrame:
    """The queue after offering jobs again: one row for each key, what is there already stays."""
    fresh = offered.dropDuplicates(keys).join(jobs.select(*keys), keys, "left_anti")
    return jobs.unionByName(fresh.select(*jobs.columns))


def advance(old: Column, new: Column) -> Column:
    """A checkpoint never moves back."""
    return F.greatest(old, new)


def stream_revisions(spark: SparkSession, path: str, schema: str, time: str, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """A file stream of revisions, each once within the watermark's delay."""
    return spark.readStream.schema(schema).parquet(path).withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts of each window and group; late rows within the delay still count."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), by).count()


def run_available(stream: DataFrame, checkpoint: str, commit: Callable[[DataFrame, int], None]) -> None:
    """Process what is there in micro-batches; ``commit`` gets each batch with its number and must be idempotent in it."""
    stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def parquet_commit(path: str) -> Callable[[DataFrame, int], None]:
    """A commit that writes each batch into a folder of its number, so that a repeated batch replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
