"""Greedy tracking: frames from last to first, edges by rising cost, at most one parent and two children."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import FEW, cut, work_folder


def choose(edges, children_allowed: tuple[int, int]):
    """Selected (source, target) of a frame's edges (source, target, metric, first).

    First the edges of sources in the selected set, whose targets may have up
    to two children; then, where the second allowance is positive, those of
    other sources, whose targets must have none. Ties: source, then target.
    """
    parent, children, out = set(), {}, []
    for stage, most in enumerate(children_allowed):
        for source, target, _, first in sorted(edges, key=lambda e: (e[2], e[0], e[1])):
            if bool(first) == (stage == 0) and source not in parent and children.get(target, 0) < most:
                parent.add(source)
                children[target] = children.get(target, 0) + 1
                out.append((source, target))
    return out


def choose_by_rounds(edges: DataFrame, children_allowed: tuple[int, int]) -> DataFrame:
    """``choose`` by joins and groupings, for frames of any size.

    An edge that is the first of the open edges of its source and of its target
    is taken: nothing before it can be in its way. Then the edges of its source
    go, and those of its target once that has all its children.
    """
    taken = None
    key = F.struct("metric", "source", "target")
    for stage, most in enumerate(children_allowed):
        if not most:
            continue
        open_ = edges.filter(F.col("first") == (stage == 0)).select("source", "target", "metric")
        while True:
            if taken is not None:
                full = taken.groupBy("target").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most).select("target")
                open_ = open_.join(taken.select("source"), "source", "left_anti").join(full, "target", "left_anti")
            open_ = cut(open_)
            if open_.isEmpty():
                break
            of_source = open_.groupBy("source").agg(F.min(key).alias("k"))
            of_target = open_.groupBy("target").agg(F.min(key).alias("k2"))
            now = of_source.select("k.source", "k.target", "k").join(of_target, "target").filter("k = k2").select("source", "target")
            taken = cut(now if taken is None else taken.unionByName(now))
    return edges.select("source", "target").limit(0) if taken is None else taken


def runs_of(frames: list[int], sizes: dict[int, int], few: int) -> list[list[int]]:
    """Consecutive frames that have at most ``few`` edges together; a frame of more is a run by itself."""
    out: list[list[int]] = []
    room = -1
    for frame in frames:
        n = sizes.get(frame, 0)
        if n > few or n > room:
            out.append([])
            room = few if n <= few else -1
        out[-1].append(frame)
        room -= n
    return out


def choose_run(rows: list[tuple], frames: list[int], allowed: tuple[int, int], threshold: float) -> list[tuple[int, int, int]]:
    """(frame, source, target) chosen in a run of frames from last to first; rows are (frame, source, target, metric, score of the source, whether it is chosen before the run)."""
    by_frame: dict[int, list[tuple]] = {}
    for t, *edge in rows:
        by_frame.setdefault(t, []).append(edge)
    out, selected = [], None
    for frame in frames:
        here = []
        for source, target, metric, score, given in by_frame.get(frame, ()):
            first = given if selected is None else source in selected
            if first or score > threshold:
                here.append((source, target, metric, first))
        chosen = choose(here, allowed)
        out += [(frame, s, t) for s, t in chosen]
        selected = {t for _, t in chosen}
    return out


def greedy_track(nodes: DataFrame, edges: DataFrame, metric: str = "prediction_distance", node_threshold: float = 0.2, allow_new_tracks: bool = True, few: int = FEW) -> DataFrame:
    """(source, target) of the selected edges.

    Frames depend on one another, from last to first. Edges are written once by
    runs of frames that are counted to have at most ``few`` of them, and each run
    is one job that reads its own part: one task goes through its frames. A
    larger frame is a run by itself, chosen by rounds, with the same result.
    Sources in the selected set are the targets chosen a frame later; in the last
    frame, all cells above the threshold. What is chosen is written run by run.
    """
    at = nodes.select("id", "t", "score")
    rows = edges.select("source", "target", F.col(metric).alias("metric")).join(at.select(F.col("id").alias("source"), "t", F.col("score").alias("s_score")), "source")
    rows = cut(rows.join(at.select(F.col("id").alias("target"), F.col("score").alias("t_score")), "target").filter(F.col("t_score") >= node_threshold))
    sizes = {r["t"]: r["n"] for r in rows.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}  # two numbers a frame
    frames = [r["t"] for r in nodes.select("t").distinct().orderBy(F.desc("t")).collect()]
    if not frames or not sizes:
        return edges.select("source", "target").limit(0)
    runs, allowed, spark = runs_of(frames, sizes, few), (2, 1 if allow_new_tracks else 0), nodes.sparkSession
    given, found = work_folder(spark, "greedy-edges"), work_folder(spark, "greedy-chosen")
    number = spark.createDataFrame([(t, k) for k, run in enumerate(runs) for t in run], "t int, run int")  # two numbers a frame
    by_run = rows.select(F.col("t").cast("int").alias("t"), "source", "target", "metric", "s_score").join(F.broadcast(number), "t")
    by_run.repartition("run", "t").write.partitionBy("run").parquet(given)

    selected = nodes.filter((F.col("t") == frames[0]) & (F.col("score") > node_threshold)).select("id")
    for k, run in enumerate(runs):
        if not any(sizes.get(t) for t in run):
            selected = selected.limit(0)
            continue
        here = spark.read.schema("t int, source bigint, target bigint, metric double, s_score double").parquet(f"{given}/run={k}")
        here = here.join(selected.withColumn("first", F.lit(True)), F.col("source") == F.col("id"), "left").select("t", "source", "target", "metric", "s_score", (F.coalesce("first", F.lit(False)) & (F.col("t") == run[0])).alias("first"))
        if sum(sizes.get(t, 0) for t in run) <= few:

            def kernel(batches: Iterator[pd.DataFrame], run: list[int] = run) -> Iterator[pd.DataFrame]:
                some = [r for batch in batches for r in batch.itertuples(index=False, name=None)]
                yield pd.DataFrame(choose_run(some, run, allowed, node_threshold), columns=["t", "source", "target"])

            chosen = here.coalesce(1).mapInPandas(kernel, "t int, source bigint, target bigint")
        else:
            whole = cut(here.filter(F.col("first") | (F.col("s_score") > node_threshold)).select("source", "target", "metric", "first"))
            chosen = choose_by_rounds(whole, allowed).select(F.lit(run[0]).cast("int").alias("t"), "source", "target")
        chosen.write.parquet(f"{found}/run={k}")
        selected = spark.read.schema("t int, source bigint, target bigint").parquet(f"{found}/run={k}").filter(F.col("t") == run[-1]).select(F.col("target").alias("id")).distinct()
    return spark.read.schema("t int, source bigint, target bigint, run int").parquet(found).select("source", "target")
