"""Cells, annotated tracks and a reconstruction derived from the events table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.components import cut

REC_OFFSET = 1_000_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell an event: the day is the frame, props.k, the user and the value are z, y and x."""
    e = read(spark, sf_dir, "events")
    modulo = lambda n, shift: ((F.col("event_id") % n).cast("double") - shift)
    return e.select(
        F.col("event_id").alias("id"), F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("t"),
        F.get_json_object("props", "$.k").cast("double").alias("z"), F.col("user_id").cast("double").alias("y"), F.col("value").alias("x"), (F.col("value") / 500.0).alias("score"),
        modulo(7, 3.0).alias("mv_z"), modulo(5, 2.0).alias("mv_y"), modulo(11, 5.0).alias("mv_x"),
    )


@dataclass(frozen=True)
class Graph:
    """Nodes (id, t, z, y, x, ...) and edges (source, target); a source is one frame later than its target."""

    nodes: DataFrame
    edges: DataFrame


def tracks_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotated tracks table: the first two cells of a user and day; the parent is the user's first cell of the day before; -1 is none."""
    ranked = cells(spark, sf_dir).withColumn("rk", F.row_number().over(Window.partitionBy("y", "t").orderBy("id"))).filter("rk <= 2")
    first = ranked.filter("rk = 1").select(F.col("id").alias("parent"), F.col("y").alias("py"), (F.col("t") + 1).alias("pt"))
    return ranked.join(first, (F.col("y") == F.col("py")) & (F.col("t") == F.col("pt")), "left").select(
        "t", "z", "y", "x", F.col("id").alias("cell_id"), F.coalesce("parent", F.lit(-1)).alias("parent_id"), "y", "rk"
    ).select("t", "z", "y", "x", "cell_id", "parent_id", "rk")


def annotation(tracks: DataFrame) -> Graph:
    edges = tracks.filter("parent_id <> -1").select(F.col("cell_id").alias("source"), F.col("parent_id").alias("target"))
    return Graph(tracks.select(F.col("cell_id").alias("id"), "t", "z", "y", "x"), edges)


def reconstruction(tracks: DataFrame) -> Graph:
    """The annotation moved by 0.25 in x, with some edges missing."""
    gone = (F.col("cell_id") % 13 == 0) | (F.col("rk") == 2) & (F.col("cell_id") % 7 == 0)
    edges = tracks.filter("parent_id <> -1").filter(~gone).select((F.col("cell_id") + REC_OFFSET).alias("source"), (F.col("parent_id") + REC_OFFSET).alias("target"))
    return Graph(tracks.select((F.col("cell_id") + REC_OFFSET).alias("id"), "t", "z", "y", (F.col("x") + 0.25).alias("x")), edges)


def gt(spark: SparkSession, sf_dir: str, often: bool = False) -> Graph:
    """The annotation; where it is read ``often``, its tracks are made once and kept."""
    tracks = tracks_file(spark, sf_dir)
    return annotation(cut(tracks) if often else tracks)


def both(spark: SparkSession, sf_dir: str) -> tuple[Graph, Graph]:
    """Annotation and reconstruction. A matching reads their nodes and edges many times, so the tracks they come from are made once and kept."""
    tracks = cut(tracks_file(spark, sf_dir))
    return annotation(tracks), reconstruction(tracks)
