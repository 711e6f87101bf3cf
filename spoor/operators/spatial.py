"""Distance range joins on points, by equal frames (or neighbouring ones) and a grid of cells a few radii wide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roi import distance2, frame_value

SPACE = ("z", "y", "x")


#: Width of a grid cell in radii: a ball touches (1 + 2 / WIDE) cells a dimension on average, 3.4 in space.
WIDE = 4.0


def _cell(place: Column, largest: float) -> Column:
    return F.floor(place / (WIDE * largest)).cast("bigint")


def touched(left: DataFrame, largest: float, dims=SPACE) -> DataFrame:
    """A row for each cell (_a0, _a1, ...) that the ball around a left row touches, taken a little larger for what rounding moves over a border."""
    reach = largest * (1 + 1e-6)
    for i, d in enumerate(dims):
        left = left.withColumn(f"_a{i}", F.explode(F.sequence(_cell(F.col("a_" + d) - reach, largest), _cell(F.col("a_" + d) + reach, largest))))
    return left


def range_join(left: DataFrame, right: DataFrame, radius: float | Column, largest: float, frame: Column | None = None, dims=SPACE, strict: bool = False) -> DataFrame:
    """Pairs of a left and a right row of equal key frame at most ``radius`` apart.

    ``left`` has columns a_id, a_t, a_z, a_y, a_x; ``right`` b_id and so on. ``frame``
    is the right frame that a left row asks for (its own by default). The right
    side is dealt once to its grid cell (edges of ``WIDE`` times ``largest``, the
    greatest radius); each left row looks at the cells that its ball touches, so
    few copies of it are shuffled. The join is by merging on (frame, cell) with
    the distance as a residual: no frame is a cross product, no side is assumed
    to be small, and none is gathered at the driver for a broadcast.
    """
    probe = touched(left.withColumn("_t", F.col("a_t") if frame is None else frame), largest, dims)
    table = right.select("*", *[_cell(F.col("b_" + d), largest).alias(f"_b{i}") for i, d in enumerate(dims)])
    on = F.col("_t") == F.col("b_t")
    for i in range(len(dims)):
        on = on & (F.col(f"_a{i}") == F.col(f"_b{i}"))
    limit = radius if isinstance(radius, Column) else F.lit(float(radius))
    within = distance2(dims=dims) < limit * limit if strict else distance2(dims=dims) <= limit * limit
    found = probe.join(table.hint("merge"), on & within)
    return found.drop("_t", *[f"_a{i}" for i in range(len(dims))], *[f"_b{i}" for i in range(len(dims))])


def points(nodes: DataFrame, prefix: str, extra=(), moved: bool = False) -> DataFrame:
    place = {d: F.col(d) + F.col("mv_" + d) if moved else F.col(d) for d in SPACE}
    return nodes.select(F.col("id").alias(prefix + "id"), F.col("t").alias(prefix + "t"), *[place[d].alias(prefix + d) for d in SPACE], *[F.col(c).alias(prefix + c) for c in extra])


def candidate_edges(cells: DataFrame, threshold: float | dict[int, float], use_motion: bool = True) -> DataFrame:
    """Edges (source, target, t, distance, prediction_distance) from each cell to the cells of the frame before that lie in the ball
    around its predicted place (its own without ``use_motion``). A map of thresholds is looked up by the source's frame."""
    largest = float(max(threshold.values())) if isinstance(threshold, dict) else float(threshold)
    radius = frame_value(F.col("a_t"), threshold) if isinstance(threshold, dict) else largest
    place = {d: F.col(d) + F.col("mv_" + d) if use_motion else F.col(d) for d in SPACE}
    # Only one of both places besides a_ is carried: the own one, or the motion that leads to the predicted one.
    other = [F.col(d).alias("s_" + d) if use_motion else F.col("mv_" + d) for d in SPACE]
    source = cells.select(F.col("id").alias("a_id"), F.col("t").alias("a_t"), *[place[d].alias("a_" + d) for d in SPACE], *other)
    found = range_join(source, points(cells, "b_"), radius, largest, F.col("a_t") - 1)
    if not use_motion:
        found = found.withColumns({"p_" + d: F.col("a_" + d) + F.col("mv_" + d) for d in SPACE})
    own, predicted = ("s_", "a_") if use_motion else ("a_", "p_")
    return found.select(F.col("a_id").alias("source"), F.col("b_id").alias("target"), F.col("a_t").alias("t"), F.sqrt(distance2(own)).alias("distance"), F.sqrt(distance2(predicted)).alias("prediction_distance"))


def node_pairs(x: DataFrame, y: DataFrame, threshold: float) -> DataFrame:
    """Pairs (frame, x, y, distance) of nodes of two graphs in the same frame at most ``threshold`` apart."""
    found = range_join(points(x, "a_"), points(y, "b_"), threshold, threshold)
    return found.select(F.col("a_t").alias("frame"), F.col("a_id").alias("x"), F.col("b_id").alias("y"), F.sqrt(distance2()).alias("distance"))


def edge_costs(x_edges: DataFrame, y_edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of edges whose sources and whose targets are node pairs: (x_source, x_target, y_source, y_target, cost = sum of both distances).

    Only edges over one frame can match, as pairs are within a frame and both edges' frames must be neighbours.
    """
    at = lambda end: pairs.select(F.col("frame").alias(f"{end}_frame"), F.col("x").alias(f"x_{end}"), F.col("y").alias(f"y_{end}"), F.col("distance").alias(f"{end}_distance"))
    xe = x_edges.select(F.col("source").alias("x_source"), F.col("target").alias("x_target"))
    ye = y_edges.select(F.col("source").alias("y_source"), F.col("target").alias("y_target"))
    found = xe.join(at("source"), "x_source").join(ye, "y_source").join(at("target"), ["x_target", "y_target"]).filter("source_frame = target_frame + 1")
    return found.select(F.col("source_frame").alias("frame"), "x_source", "x_target", "y_source", "y_target", (F.col("source_distance") + F.col("target_distance")).alias("cost"))


def node_recall(candidates: DataFrame, gt: DataFrame, threshold: float, score_threshold: float | None = None) -> DataFrame:
    """One row (matches, total): annotated nodes with a candidate in the ball around them."""
    from .filters import score_at_least

    found = range_join(points(gt, "a_"), points(score_at_least(candidates, score_threshold), "b_"), threshold, threshold).select("a_id").distinct()
    return gt.join(found, F.col("id") == F.col("a_id"), "left").agg(F.count("a_id").alias("matches"), F.count(F.lit(1)).alias("total"))


def edge_recall(candidates: DataFrame, gt_nodes: DataFrame, gt_edges: DataFrame, threshold: float, move: float, around_source: bool = False) -> DataFrame:
    """One row (matches, total): annotated edges with a candidate near the source and one near the target less than ``move`` apart.

    ``around_source`` looks for the target's candidates around the source's place instead.
    """
    space = [F.col(d) for d in SPACE]
    near = range_join(points(gt_nodes, "a_"), points(candidates, "b_"), threshold, threshold).select(F.col("a_id").alias("node"), *[F.col("b_" + d) for d in SPACE])
    if around_source:
        ends = gt_edges.join(gt_nodes.select(F.col("id").alias("source"), "t", *space), "source").withColumn("t", F.col("t") - 1)
        ends = ends.select(F.col("target").alias("a_id"), F.col("t").alias("a_t"), *[F.col(d).alias("a_" + d) for d in SPACE])
        near_target = range_join(ends, points(candidates, "b_"), threshold, threshold).select(F.col("a_id").alias("node"), *[F.col("b_" + d) for d in SPACE])
    else:
        near_target = near
    s = near.select(F.col("node").alias("source"), *[F.col("b_" + d).alias("a_" + d) for d in SPACE])
    t = near_target.select(F.col("node").alias("target"), *[F.col("b_" + d) for d in SPACE])
    found = gt_edges.select("source", "target").join(s, "source").join(t, "target").filter(distance2() < move * move).select("source", "target").distinct()
    hit = found.withColumn("hit", F.lit(1))
    return gt_edges.select("source", "target").join(hit, ["source", "target"], "left").agg(F.count("hit").alias("matches"), F.count(F.lit(1)).alias("total"))
