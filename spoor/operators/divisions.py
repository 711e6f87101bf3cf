"""Division reports with leniency in frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.components import cut
from .match import assign
from .spatial import points, range_join
from ..functions.roi import distance2


def construct_costs(gt: DataFrame, rec: DataFrame, shift: int, threshold: float) -> DataFrame:
    """(x, y, cost) of annotated points and reconstructed points ``shift`` frames later at most ``threshold`` apart."""
    found = range_join(points(gt, "a_"), points(rec, "b_"), threshold, threshold, F.col("a_t") + shift)
    return found.select(F.col("a_id").alias("x"), F.col("b_id").alias("y"), F.sqrt(distance2()).alias("cost"))


def division_reports(gt: DataFrame, rec: DataFrame, target_frame: int, threshold: float, frame_buffer: int) -> DataFrame:
    """(leniency, gt_total, rec_total, fp, fn, precision, recall, f1) for leniency 0 to ``frame_buffer``.

    Points of the target frame are matched to each other; then annotated points
    left over to reconstructed ones b frames away, and reconstructed points left
    over likewise, for b up to the leniency. Undefined rates are null.
    Other frames are never compared, so points of these alone are computed, once.
    """
    at = F.col("t") == target_frame
    near = F.col("t").between(target_frame - frame_buffer, target_frame + frame_buffer)
    gt, rec = cut(gt.filter(near)), cut(rec.filter(near))
    gt_left, rec_left = gt.filter(at), rec.filter(at)
    totals = gt_left.agg(F.count(F.lit(1)).alias("gt_total")).join(rec_left.agg(F.count(F.lit(1)).alias("rec_total")))
    gt_free, rec_free = gt, rec
    out = None
    for leniency in range(frame_buffer + 1):
        for shift in {leniency, -leniency}:
            m = _assigned(gt_left.join(gt_free.select("id"), "id", "left_semi"), rec_free, shift, threshold)
            gt_free, rec_free = gt_free.join(m, F.col("id") == F.col("gt_id"), "left_anti"), rec_free.join(m, F.col("id") == F.col("rec_id"), "left_anti")
            if leniency:
                m = _assigned(gt_free, rec_left.join(rec_free.select("id"), "id", "left_semi"), shift, threshold)
                gt_free, rec_free = gt_free.join(m, F.col("id") == F.col("gt_id"), "left_anti"), rec_free.join(m, F.col("id") == F.col("rec_id"), "left_anti")
            gt_free, rec_free = cut(gt_free), cut(rec_free)
        left = gt_free.filter(at).agg(F.count(F.lit(1)).alias("fn")).join(rec_free.filter(at).agg(F.count(F.lit(1)).alias("fp")))
        one = left.join(totals).select(F.lit(leniency).alias("leniency"), "gt_total", "rec_total", "fp", "fn", *rates(F.col("gt_total"), F.col("rec_total"), F.col("fp"), F.col("fn")))
        out = one if out is None else out.union(one)
    return out


def _assigned(gt: DataFrame, rec: DataFrame, shift: int, threshold: float) -> DataFrame:
    found = assign(construct_costs(gt, rec, shift, threshold), threshold + 1.0)
    return cut(found.select(F.col("x").alias("gt_id"), F.col("y").alias("rec_id")))


def rates(gt_total: Column, rec_total: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and F1 of matched over all points of either side; null where undefined."""
    none = lambda c: F.nullif(c, F.lit(0))
    precision, recall = (rec_total - fp) / none(rec_total), (gt_total - fn) / none(gt_total)
    return [precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / F.nullif(precision + recall, F.lit(0.0))).alias("f1")]


def write_report(report: DataFrame, path: str) -> None:
    """The report (one row a leniency) as one CSV file with a header; undefined rates are empty."""
    report.orderBy("leniency").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
