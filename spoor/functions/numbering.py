"""Row numbers over a whole table without bringing it to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import cut


def dense_numbers(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with numbers from 0 in the given order: range partitions are numbered within, and sums over partitions (one row each) shift them."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1)
    return numbered.join(before, "_part").withColumn(name, F.col("_before") + F.col("_r")).drop("_part", "_before", "_r")


def percentiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles, linear between ranks: rows are numbered by ranges, so no task sees all values; two numbers a share reach the driver."""
    numbered = cut(dense_numbers(rows.select(F.col(column).cast("double").alias("_v")).filter("_v is not null"), ["_v"], "_rank"))
    n = numbered.count()
    if not n:
        return [None] * len(shares)
    places = [s * (n - 1) for s in shares]
    wanted = sorted({k for p in places for k in (int(p), min(int(p) + 1, n - 1))})
    at = {r["_rank"]: r["_v"] for r in numbered.filter(F.col("_rank").isin(wanted)).collect()}
    return [at[int(p)] + (at[min(int(p) + 1, n - 1)] - at[int(p)]) * (p - int(p)) for p in places]
