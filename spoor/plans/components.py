"""Connected components with joins and groupings only: alternating large-star and small-star rounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType


def cut(df: DataFrame, _round: int = 0) -> DataFrame:
    """Cut lineage with a reliable checkpoint; a folder of our own only where ``spark.checkpoint.dir`` is unset and driver and executors are one process."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="spoor-"))
    return df.checkpoint()


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder, which driver and executors share."""
    cut(spark.range(1))  # sets the folder, or tells that there is none
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into a new work folder and read it back. Unlike a checkpoint, which keeps the plan's estimate of its size, this leaves
    the size of the files: in a loop with joins estimates are multiplied, and their digits would outgrow the driver's memory."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_by_key(rows: DataFrame, one_per_key: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on the key wrapped in a struct: both sides are dealt anew, so that AQE may split a key with very many rows,
    which it cannot where an aggregate's own partitions are joined in place. The join merges, however small the other side's files are."""
    other = one_per_key.select(F.struct(key).alias("_key"), *[c for c in one_per_key.columns if c != key])
    return rows.join(other.hint("merge"), F.struct(key) == F.col("_key"), how).drop("_key")


def broadcast_if_small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, marked for broadcast if it is counted to have at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


#: Edges that one task may finish: a few dozen MB at most, known by a count.
FEW = 200_000


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b) for every node: the least node of its component."""
    parent: dict = {}

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"]):
            low, high = sorted((root(parent.setdefault(a, a)), root(parent.setdefault(b, b))))
            parent[high] = low
    if parent:
        yield pd.DataFrame({"a": list(parent), "b": [root(i) for i in parent]})


def connected_components(edges: DataFrame, keep: Callable[[DataFrame, int], DataFrame] = lambda df, k: stored(df, f"classes-{k}"), few: int = FEW) -> DataFrame:
    """(node, component) for every node of an edge of ``edges`` (a, b): the component is its least node.

    Directions, repeats and loops do not matter, except that a node with loops
    only is not returned. ``keep`` stores what a round yields and cuts lineage.
    Rounds grow with the logarithm of the longest path; a round shuffles edges
    by node, after partial minima, so a node of very high degree is split by AQE.
    Once a count shows at most ``few`` edges, one task finishes with the same result.
    """
    pairs = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 0)
    before, rounds = None, 1
    while True:
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now["n"] <= few and pairs.schema["a"].dataType in (LongType(), IntegerType(), StringType()):
            found = pairs.coalesce(1).mapInPandas(_finish, pairs.schema)
            return keep(found, rounds).select(F.col("a").alias("node"), F.col("b").alias("component"))
        if now == before:
            break
        both = pairs.union(pairs.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = join_by_key(both.filter("v > u"), least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = join_by_key(large, lower, "a").filter("b <> m").select("b", "m").union(lower.select("a", "m")).toDF("a", "b").distinct()
        pairs = keep(linked, rounds)
        before, rounds = now, rounds + 1
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct())
