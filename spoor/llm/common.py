"""Shared helpers: the work folder all executors see, written tables, packed rows."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a folder of our own only where that is unset and driver and executors are one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark.sparkContext, "_spoor_work_dir", None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="spoor-")
            spark.sparkContext._spoor_work_dir = base
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared work folder and read it back: lineage ends there."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """``row`` holds all columns of ``df``, so that names of extra columns cannot clash with ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.select(*[F.col("row").getField(c).alias(c) for c in like.columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda that names an expression would compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Rows of a few dozen bytes: about 20 MB in memory on each executor at most.
BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast if it is counted to have at most ``most`` rows; beyond that, joins shuffle. ``df`` should be cheap to count."""
    return F.broadcast(df) if df.count() <= most else df


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition's batches; at its end the worker, which Spark keeps, gives freed memory back to the system."""

    @wraps(run)
    def partition(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return partition
