"""A graph store: a folder of Parquet tables for one sample, checkpoint and threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.roi import Roi
from ..operators.filters import keep_incident
from ..operators.graph import selected_graph
from ..operators.results import find_parameters, upsert, with_next_ids
from ..streaming.ledger import finish, unfinished

#: Flags are stored by parameter set and colour of their block, so that a solve writes its own part only.
FLAG_PARTS = ["param_id", "colour"]
TABLES = ("nodes", "edges", "selections", "parameters", "scores", "done", "meta")


@dataclass
class GraphStore:
    spark: SparkSession
    path: str
    mode: str = "r"

    def __post_init__(self):
        if self.mode == "w":
            for name in TABLES:
                self._delete(name)

    def _hadoop(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, name: str) -> None:
        p, fs = self._hadoop(name)
        fs.delete(p, True)

    def _version(self, name: str) -> int:
        """The greatest version of a table that was written to its end; 0 if there is none."""
        p, fs = self._hadoop(name)
        if not fs.exists(p):
            return 0
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [f.getPath() for f in fs.listStatus(p)]
        return max((int(f.getName()[1:]) for f in found if f.getName()[1:].isdigit() and fs.exists(path(f, "_SUCCESS"))), default=0)

    def has(self, name: str) -> bool:
        return self._version(name) > 0

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/v{self._version(name)}")

    def write(self, name: str, rows: DataFrame, by: list[str] | None = None) -> None:
        """Append; with ``by`` the table is partitioned (nodes and edges by frame, so that a box prunes files), and the partitions that
        ``rows`` has take the place of those there: writing twice changes nothing."""
        if self.mode == "r":
            raise ValueError("store is read-only")
        version = f"{name}/v{max(1, self._version(name))}"
        path = f"{self.path}/{version}"
        if by:
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
            mark, fs = self._hadoop(f"{version}/_SUCCESS")  # overwriting partitions leaves no mark
            fs.create(mark, True).close()
        else:
            rows.write.mode("append").parquet(path)

    def replace(self, name: str, rows: DataFrame, by: list[str] | None = None) -> None:
        """Write the next version; it counts once it is whole, and only then older ones go. A crash leaves the old or the new table."""
        before = self._version(name)
        rows.write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{self.path}/{name}/v{before + 1}")
        for k in range(1, before + 1):
            self._delete(f"{name}/v{k}")

    def finished(self, step: str, blocks: DataFrame) -> None:
        """Note in the ledger that a step is done with these blocks (block_id). Rows are only added, so that several writers lose none."""
        self.write("done", finish(self.spark.createDataFrame([], "step string, block_id bigint"), self.open_blocks(step, blocks), step))

    def open_blocks(self, step: str, blocks: DataFrame) -> DataFrame:
        return unfinished(blocks, self.read("done"), step) if self.has("done") else blocks

    def graph(self, roi: Roi | None = None, edge_columns: list[str] | None = None, side_table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes in the box (with a side table's columns by id) and the edges whose source is in it."""
        nodes = self.read("nodes")
        if roi is not None:
            nodes = nodes.filter(roi.contains())
        if side_table is not None:
            nodes = nodes.join(side_table, "id", "left")
        edges = self.read("edges")
        edges = edges.select("source", "target", *(edge_columns or [c for c in edges.columns if c not in ("source", "target")]))
        return nodes, edges.join(nodes.select(F.col("id").alias("source")), "source", "left_semi") if roi is not None else edges

    def selections(self) -> DataFrame:
        """All flags; none where nothing was solved yet."""
        if self.has("selections"):
            return self.read("selections")
        return self.spark.createDataFrame([], "source bigint, target bigint, selected boolean, param_id bigint, colour int")

    def write_flags(self, rows: DataFrame, param_id: int, colour: int) -> None:
        """Flags (source, target, selected) of a parameter set, in place of those of this colour; other sets and colours stay."""
        self.write("selections", rows.select("source", "target", "selected", F.lit(param_id).alias("param_id"), F.lit(colour).alias("colour")), by=FLAG_PARTS)

    def flags(self, param_id: int, colours: list[int]) -> DataFrame | None:
        """What is set already for a parameter set in blocks of these colours."""
        if not colours or not self.has("selections"):
            return None
        return self.read("selections").filter((F.col("param_id") == param_id) & F.col("colour").isin(colours)).select("source", "target", "selected")

    def selected(self, param_id: int, roi: Roi | None = None) -> tuple[DataFrame, DataFrame]:
        nodes, edges = self.graph(roi)
        return selected_graph(nodes, keep_incident(edges, nodes), self.selections(), param_id)

    def reset_selection(self, param_ids: list[int] | None = None, roi: Roi | None = None) -> None:
        """Forget flags: of the given sets (or all), of edges whose source is in the box (or all); without a box the ledger forgets solving too."""
        flags = self.selections()
        kept = reset(flags, None if roi is None else self.read("nodes").filter(roi.contains()), param_ids)
        if kept.isEmpty():
            self._delete("selections")
        else:
            self.replace("selections", kept, by=FLAG_PARTS)
        if roi is None and self.has("done"):
            self.replace("done", self.read("done").filter(~F.col("step").startswith("solve")))

    def parameter_ids(self, wanted: DataFrame, columns: list[str], decimals: int | None = None) -> DataFrame:
        """``wanted`` with ids: stored ones, and new ones on from the greatest for the rest, which are stored."""
        if not self.has("parameters"):
            stored = wanted.limit(0).withColumn("param_id", F.lit(None).cast("bigint"))
        else:
            stored = self.read("parameters")
        found = find_parameters(stored, wanted, columns, decimals)
        new = found.filter("param_id is null").drop("param_id").distinct()
        if not new.isEmpty():
            self.write("parameters", with_next_ids(stored, new, columns).select(*columns, "param_id"))
        return find_parameters(self.read("parameters"), wanted, columns, decimals)

    def parameters(self, ids: list[int]) -> DataFrame:
        """The asked sets in order; unknown ids give a row of nulls."""
        asked = self.spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "asked bigint, place int")
        return asked.join(self.read("parameters"), F.col("asked") == F.col("param_id"), "left").orderBy("place")

    def write_score(self, score: DataFrame, key: list[str]) -> None:
        """Insert, or replace the score of equal key."""
        self.replace("scores", upsert(self.read("scores"), score, key)) if self.has("scores") else self.write("scores", score)

    def scores(self, predicate=None) -> DataFrame:
        return self.read("scores") if predicate is None else self.read("scores").filter(predicate)


def reset(selections: DataFrame, nodes: DataFrame | None, param_ids: list[int] | None) -> DataFrame:
    """Flags that stay."""
    goes = F.lit(True) if param_ids is None else F.col("param_id").isin(param_ids)
    if nodes is None:
        return selections.filter(~goes)
    inside = nodes.select(F.col("id").alias("source")).distinct().withColumn("_in", F.lit(True))
    return selections.join(inside.hint("merge"), "source", "left").filter(~(goes & F.coalesce("_in", F.lit(False)))).drop("_in")


def find(registry: DataFrame, wanted: dict, with_roi: bool = True) -> str | None:
    """The name of the one dataset whose meta row equals ``wanted``; None if there is none; several are an error."""
    rows = registry
    for k, v in wanted.items():
        if with_roi or k != "roi":
            rows = rows.filter(F.col(k).eqNullSafe(F.lit(v)))
    names = [r["name"] for r in rows.select("name").limit(2).collect()]
    if len(names) > 1:
        raise ValueError("several datasets match")
    return names[0] if names else None


def find_or_create(registry: GraphStore, wanted: dict, with_roi: bool = True) -> str:
    """The name of the dataset that equals ``wanted`` in the registry's meta table; a new row, named after its values, if there is none."""
    if registry.has("meta") and (name := find(registry.read("meta"), wanted, with_roi)):
        return name
    taken = {r["name"] for r in registry.read("meta").select("name").collect()} if registry.has("meta") else set()  # one name a dataset
    base = dataset_name(*wanted.values())
    name = next(n for n in (base, *(f"{base}_{k}" for k in range(2, len(taken) + 3))) if n not in taken)
    row = registry.spark.createDataFrame([(name, *wanted.values())], ", ".join(["name string", *(f"`{k}` {_sql_type(v)}" for k, v in wanted.items())]))
    registry.write("meta", row)
    return name


def _sql_type(value) -> str:
    return {bool: "boolean", int: "bigint", float: "double"}.get(type(value), "string")


def dataset_name(*parts) -> str:
    """A deterministic name of its parts."""
    return "_".join(str(p).strip("/").replace("/", "_") for p in parts if p is not None)
