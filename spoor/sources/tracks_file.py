"""Track tables in text files: header ``t z y x cell_id parent_id track_id [radius name div_state]``."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.roi import Roi
from ..operators.filters import division_state, where_equal
from .tables import Graph

REQUIRED = ("t", "z", "y", "x", "cell_id", "parent_id", "track_id")


def sniff(spark: SparkSession, path: str) -> str:
    """The file's delimiter, from its first lines; a file without a header is an error."""
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(10).collect())[:1024]
    dialect = csv.Sniffer().sniff(head, delimiters=" ,;\t")
    names = next(csv.reader([head.split("\n", 1)[0]], dialect))
    if not set(REQUIRED[:6]) <= {n.strip() for n in names}:
        raise ValueError(f"no header in {path}")
    return dialect.delimiter


def read_tracks(spark: SparkSession, path: str, scale: tuple = (1.0, 1.0, 1.0, 1.0), roi: Roi | None = None, with_state: bool = False, values: dict | None = None, single_precision: bool = False, strict: bool = False) -> DataFrame:
    """Tracks with typed columns; of rows with one cell_id the last in the file counts.

    ``scale`` multiplies t, z, y, x (after a cast through 32-bit floats if
    ``single_precision``); then the box, the division state and the equality
    filter on attributes apply.
    """
    raw = spark.read.csv(path, header=True, sep=sniff(spark, path), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    number = lambda c: F.col(c).cast("float").cast("double") if single_precision else F.col(c).cast("double")
    place = {d: number(d) * float(s) for d, s in zip(("t", "z", "y", "x"), scale)}
    rest = {"cell_id": "bigint", "parent_id": "bigint", "track_id": "bigint", "radius": "double", "name": "string", "div_state": "int"}
    rows = raw.select(*[e.alias(d) for d, e in place.items()], *[F.col(c).cast(k).alias(c) for c, k in rest.items() if c in raw.columns], F.monotonically_increasing_id().alias("_line"))
    # Line numbers grow along a file; struct maxima keep the last row of an id without a window over the file.
    rows = rows.groupBy("cell_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("cell_id", "_line")]), "_line").alias("r")).select("cell_id", "r.*")
    rows = rows.withColumn("t", F.floor("t").cast("int"))
    if with_state and "div_state" not in rows.columns:
        rows = division_state(rows, strict)
    if roi is not None:
        rows = rows.filter(roi.contains())
    return where_equal(rows, values or {})


def to_graph(tracks: DataFrame, roi: Roi | None = None, zero_is_none: bool = False) -> Graph:
    """Nodes, and edges to parents that are kept too; -1 (with ``zero_is_none`` anything below 1) is no parent."""
    if roi is not None:
        tracks = tracks.filter(roi.contains())
    names = {"cell_id": "id", "radius": "r"}
    nodes = tracks.select(*[F.col(c).alias(names.get(c, c)) for c in tracks.columns if c != "parent_id"])
    parent = tracks.filter(F.col("parent_id") > 0) if zero_is_none else tracks.filter("parent_id <> -1")
    edges = parent.select(F.col("cell_id").alias("source"), F.col("parent_id").alias("target")).join(tracks.select(F.col("cell_id").alias("target")), "target", "left_semi")
    return Graph(nodes, edges.select("source", "target"))


def bounds(nodes: DataFrame, whole: bool = False) -> DataFrame:
    """One row begin_d, end_d: least place and greatest plus 1, rounded outwards if ``whole``."""
    low = lambda d: F.floor(F.min(d)).cast("double") if whole else F.min(d).cast("double")
    high = lambda d: (F.ceil(F.max(d)) + 1).cast("double") if whole else (F.max(d) + 1).cast("double")
    return nodes.agg(*[f(d).alias(f"{name}_{d}") for d in ("t", "z", "y", "x") for name, f in (("begin", low), ("end", high))])
