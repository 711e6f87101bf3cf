"""Scores of parameter sets: sums of errors, sorting, the best over several samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sorted_results(scores: DataFrame, weights: dict[str, float], last_two: tuple[str, str], order: str = "sum_errors") -> DataFrame:
    """``scores`` with sum_errors (weighted) and sum_divs (the last two columns), both cut to whole numbers; ascending, but matched_edges descending. No scores are an error."""
    if scores.isEmpty():
        raise ValueError("no scores")
    total = sum((F.col(c) * float(w) for c, w in weights.items()), F.lit(0.0))
    out = scores.withColumn("sum_errors", total.cast("bigint")).withColumn("sum_divs", (F.col(last_two[0]) + F.col(last_two[1])).cast("bigint"))
    return out.orderBy(F.desc(order) if order == "matched_edges" else F.asc(order), "param_id")


def over_samples(scores: DataFrame, parameters: list[str], n_samples: int) -> DataFrame:
    """Scores of a parameter set summed over its samples (numbers) or the first of them (others); nulls are values; sets that lack a sample are left out."""
    rest = [(c, t) for c, t in scores.dtypes if c not in parameters and c != "sample"]
    number = ("bigint", "int", "double", "float", "smallint", "tinyint", "decimal")
    made = [F.sum(c).alias(c) if t.startswith(number) else F.min_by(c, "sample").alias(c) for c, t in rest]
    return scores.groupBy(*parameters).agg(F.count_distinct("sample").alias("_samples"), *made).filter(F.col("_samples") == n_samples).drop("_samples")


def best(scores: DataFrame, order: str = "sum_errors") -> DataFrame:
    return scores.orderBy(F.desc(order) if order == "matched_edges" else F.asc(order), "param_id").limit(1)


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those of equal key, nulls equal."""
    fresh = new.select(*[F.col(k).alias("_" + k) for k in key])
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col("_" + k))
    return stored.join(fresh, same, "left_anti").unionByName(new)


def find_parameters(stored: DataFrame, wanted: DataFrame, columns: list[str], decimals: int | None = None) -> DataFrame:
    """``wanted`` with param_id of the stored set equal in all columns (null where there is none); numbers rounded if ``decimals`` is given."""
    numbers = {c for c, t in stored.dtypes if t in ("double", "float")}
    value = lambda c, name: F.round(F.col(name), decimals) if decimals is not None and c in numbers else F.col(name)
    known = stored.select("param_id", *[value(c, c).alias("_" + c) for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & value(c, c).eqNullSafe(F.col("_" + c))
    return wanted.join(known, same, "left").drop(*["_" + c for c in columns])


def with_next_ids(stored: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """New parameter sets numbered on from the greatest stored id (1 if none)."""
    from ..functions.numbering import dense_numbers

    last = stored.agg(F.coalesce(F.max("param_id"), F.lit(0)).alias("_last"))
    return dense_numbers(new, order, "_n").join(last).withColumn("param_id", (F.col("_last") + F.col("_n") + 1).cast("bigint")).drop("_n", "_last")
