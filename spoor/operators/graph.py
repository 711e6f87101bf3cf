"""Track graphs: degrees, divisions, tracks, lengths, splitting at divisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_prev, n_next): edges back in time and forward."""
    both = edges.select(F.col("source").alias("id"), F.lit(1).alias("p"), F.lit(0).alias("n")).union(edges.select("target", F.lit(0), F.lit(1)))
    counted = both.union(nodes.select("id", F.lit(0), F.lit(0))).groupBy("id").agg(F.sum("p").alias("n_prev"), F.sum("n").alias("n_next"))
    return counted


def divisions(edges: DataFrame) -> DataFrame:
    """(parent, child1, child2) of nodes with exactly two edges forward, the children in order of id."""
    found = edges.groupBy(F.col("target").alias("parent")).agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("child1"), F.max("source").alias("child2"))
    return found.filter("n = 2").drop("n")


def tracks(nodes: DataFrame, edges: DataFrame, isolated: bool = True) -> DataFrame:
    """(id, track): weakly connected components, named by their least node. Without ``isolated``, nodes without an edge vanish."""
    found = connected_components(edges.select(F.col("source").alias("a"), F.col("target").alias("b"))).select(F.col("node").alias("id"), F.col("component").alias("track"))
    if not isolated:
        return found
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("track", "id").alias("track"))


def track_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(track, n_nodes, first_frame, last_frame)."""
    return tracks(nodes, edges).join(nodes.select("id", "t"), "id").groupBy("track").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("t").alias("first_frame"), F.max("t").alias("last_frame"))


def split_edges(edges: DataFrame) -> DataFrame:
    """(source, target, near_source, near_target): every edge into a division gets its own copy of the dividing node.

    The copy is named by the edge's source; the dividing node itself lives on
    only where it has a parent. Ends are strings, ``id`` or ``id/child``.
    """
    parents = divisions(edges).select(F.col("parent").alias("_d"))
    rows = edges.join(parents, F.col("target") == F.col("_d"), "left")
    return rows.select(
        "source", "target", F.col("source").cast("string").alias("near_source"),
        F.when(F.col("_d").isNotNull(), F.concat_ws("/", "target", "source")).otherwise(F.col("target").cast("string")).alias("near_target"),
    )


def segments(edges: DataFrame) -> DataFrame:
    """(source, target, segment): components after splitting at divisions, named by their least end."""
    cut = split_edges(edges)
    found = connected_components(cut.select(F.col("near_source").alias("a"), F.col("near_target").alias("b")))
    return cut.join(found, F.col("near_source") == F.col("node")).select("source", "target", F.col("component").alias("segment"))


def selected_graph(nodes: DataFrame, edges: DataFrame, selections: DataFrame, param_id: int) -> tuple[DataFrame, DataFrame]:
    """Edges selected for a parameter set, and the nodes they touch."""
    chosen = selections.filter((F.col("param_id") == param_id) & F.col("selected")).select("source", "target")
    kept = edges.join(chosen.hint("merge"), ["source", "target"], "left_semi")
    ends = kept.select(F.col("source").alias("_id")).union(kept.select("target")).distinct()
    return nodes.join(ends.hint("merge"), F.col("id") == F.col("_id"), "left_semi"), kept


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (begin, end, backward): the graph's frames and how many edges do not go strictly back in time; no frames at all is an error."""
    frames = nodes.filter("t is not null").agg(F.min("t").alias("begin"), (F.max("t") + 1).alias("end"))
    frames = frames.select(F.when(F.col("begin").isNull(), F.raise_error(F.lit("no node has a frame")).cast("int")).otherwise(F.col("begin")).alias("begin"), "end")
    at = nodes.select("id", "t").hint("merge")  # not gathered at the driver
    wrong = edges.join(at.toDF("source", "s_t"), "source").join(at.toDF("target", "t_t"), "target").filter("s_t <= t_t").agg(F.count(F.lit(1)).alias("backward"))
    return frames.join(wrong)
