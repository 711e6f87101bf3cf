"""Matching of two graphs: candidate pairs, then an optimal assignment for each connected set of candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assignment import best_assignment
from ..plans.components import connected_components, cut
from .spatial import edge_costs, node_pairs


def assign(costs: DataFrame, no_match: float) -> DataFrame:
    """Chosen rows (x, y, cost) of candidate pairs ``costs`` (x, y, cost), whose x and y, of any type, are unique over all frames.

    A pair that saves nothing against leaving both ends alone is never chosen. A
    pair whose ends have no other candidate is chosen. The rest form connected
    sets; each is solved by itself, which is exact because sets share no candidates.
    """
    useful = costs.filter(F.col("cost") < 2.0 * no_match)
    counted = cut(useful.withColumn("nx", F.count(F.lit(1)).over(Window.partitionBy("x"))).withColumn("ny", F.count(F.lit(1)).over(Window.partitionBy("y"))))
    alone = counted.filter("nx = 1 and ny = 1").select("x", "y", "cost")
    # Sets are named by hashes of their ends: two that fall together make one larger set, which is solved as well.
    tied = counted.filter("nx > 1 or ny > 1").select("x", "y", "cost", F.xxhash64(F.lit("x"), "x").alias("a"), F.xxhash64(F.lit("y"), "y").alias("b"))
    sets = connected_components(tied.select("a", "b"))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        least = group.sort_values("cost", kind="stable").drop_duplicates(["a", "b"]).set_index(["a", "b"])
        return least.loc[best_assignment([(a, b, c) for (a, b), c in least["cost"].items()], no_match)].reset_index()[["row"]]

    # Only names and costs go to the solver; a row's number brings its ends back.
    numbered = cut(tied.withColumn("row", F.monotonically_increasing_id()))
    grouped = numbered.select("a", "b", "cost", "row").join(sets, F.col("a") == F.col("node")).select("component", "a", "b", "cost", "row")
    chosen = grouped.groupBy("component").applyInPandas(solve, "row bigint")
    return alone.union(numbered.join(chosen, "row").select("x", "y", "cost"))


def match_nodes(x: DataFrame, y: DataFrame, threshold: float) -> DataFrame:
    """(x, y, cost): nodes matched frame by frame; leaving a node unmatched costs twice the threshold plus one."""
    return assign(node_pairs(x, y, threshold).select("x", "y", F.col("distance").alias("cost")), 2.0 * threshold + 1.0)


def candidate_edge_pairs(x, y, threshold: float) -> DataFrame:
    """Edge pairs with costs; an edge is named by its source, which has one edge back in time."""
    return edge_costs(x.edges, y.edges, cut(node_pairs(x.nodes, y.nodes, threshold)))  # both ends ask for them


def match_edges(x, y, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Matches (x_source, x_target, y_source, y_target, cost) and the y edges that had a candidate but no match."""
    pairs = cut(candidate_edge_pairs(x, y, threshold))
    key = lambda s: F.struct(F.col(f"{s}_source").alias("source"), F.col(f"{s}_target").alias("target"))
    chosen = assign(pairs.select(key("x").alias("x"), key("y").alias("y"), "cost"), 2.0 * threshold + 1.0)
    matches = cut(chosen.select(F.col("x.source").alias("x_source"), F.col("x.target").alias("x_target"), F.col("y.source").alias("y_source"), F.col("y.target").alias("y_target"), "cost"))
    unmatched = pairs.select(F.col("y_source").alias("source"), F.col("y_target").alias("target")).distinct().join(
        matches.select(F.col("y_source").alias("source"), F.col("y_target").alias("target")), ["source", "target"], "left_anti"
    )
    return matches, unmatched


def distance_stats(matches: DataFrame) -> DataFrame:
    """Average, median, least and greatest distance by frame and over all (frame is null), from rows (frame, distance)."""
    return matches.groupingSets([["frame"], []], "frame").agg(
        F.count(F.lit(1)).alias("n"), F.avg("distance").alias("avg_distance"), F.median("distance").alias("median_distance"), F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance")
    )
