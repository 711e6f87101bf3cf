"""Ledgers of finished blocks, and frames that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def block_of(frame: Column, size: int) -> Column:
    return F.floor(frame / size).cast("bigint")


def unfinished(blocks: DataFrame, done: DataFrame, step: str) -> DataFrame:
    """Blocks of a step that the ledger does not name."""
    return blocks.join(done.filter(F.col("step") == step).select("block_id"), "block_id", "left_anti")


def finish(done: DataFrame, blocks: DataFrame, step: str) -> DataFrame:
    """The ledger with these blocks; naming one again changes nothing."""
    return done.select("step", "block_id").union(blocks.select(F.lit(step).alias("step"), "block_id")).distinct()


def all_finished(blocks: DataFrame, done: DataFrame, step: str) -> bool:
    return unfinished(blocks, done, step).isEmpty()


def step_name(name: str, ids: list[int]) -> str:
    """A stable name of a step over a set of parameter ids."""
    import hashlib

    return f"{name}_{hashlib.md5(','.join(map(str, sorted(ids))).encode()).hexdigest()}"


def frame_counts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Cells per day of a stream of events (ts, value): late ones up to ``delay`` count; a day is sent once it is over."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("day")).agg(F.count(F.lit(1)).alias("n_cells"), F.avg("value").alias("mean_x"))
