"""Division errors that are none but for a frame: surroundings that agree once chains are contracted.

The surroundings of a node are its neighbours and theirs, without regard to
direction. Runs of adjoining nodes of degree two or less count as one node. As
track graphs are forests, two such graphs agree exactly if the canonical
strings of their trees do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import fn_divisions, fp_divisions


def shape(edges: list[tuple[int, int]]) -> str:
    """Canonical string of a small forest after contraction."""
    near: dict[int, set] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    merged: dict[int, int] = {}
    for v in near:
        if v not in merged and len(near[v]) <= 2:
            todo = [v]
            while todo:
                w = todo.pop()
                if w not in merged and len(near[w]) <= 2:
                    merged[w] = v
                    todo.extend(near[w])
    name = lambda v: merged.get(v, v)
    tree: dict[int, set] = {name(v): set() for v in near}
    for v, others in near.items():
        for w in others:
            if name(v) != name(w):
                tree[name(v)].add(name(w))
    out = []
    left = set(tree)
    while left:
        part, todo = set(), [next(iter(left))]
        while todo:
            v = todo.pop()
            if v not in part:
                part.add(v)
                todo.extend(tree[v])
        left -= part
        out.append(min(_rooted(tree, c, None) for c in _centres(tree, part)))
    return "".join(sorted(out))


def _centres(tree: dict, part: set) -> set:
    degree = {v: len(tree[v]) for v in part}
    rest, leaves = set(part), [v for v in part if degree[v] <= 1]
    while len(rest) > 2:
        rest -= set(leaves)
        nxt = []
        for v in leaves:
            for w in tree[v] & rest:
                degree[w] -= 1
                if degree[w] == 1:
                    nxt.append(w)
        leaves = nxt
    return rest


def _rooted(tree: dict, v: int, above: int | None) -> str:
    return "(" + "".join(sorted(_rooted(tree, w, v) for w in tree[v] if w != above)) + ")"


def _surroundings(at: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, list of edges) around the node of each row (key, node)."""
    both = edges.select(F.col("source").alias("u"), F.col("target").alias("v")).union(edges.select("target", "source"))
    one = at.join(both, F.col("node") == F.col("u")).select("key", F.col("v").alias("n"))
    two = one.join(both, F.col("n") == F.col("u")).select("key", F.col("v").alias("n"))
    inside = one.union(two).distinct()
    ends = inside.join(edges, F.col("n") == F.col("source")).select("key", "source", "target")
    kept = ends.join(inside.select(F.col("key").alias("k2"), F.col("n").alias("n2")), (F.col("key") == F.col("k2")) & (F.col("target") == F.col("n2")))
    return kept.groupBy("key").agg(F.collect_list(F.struct("source", "target")).alias("edges"))


def _agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    as_pairs = lambda rows: [(r["source"], r["target"]) for r in rows]
    for batch in batches:
        yield batch.loc[[shape(as_pairs(x)) == shape(as_pairs(y)) for x, y in zip(batch["mine"], batch["theirs"])], ["key"]].rename(columns={"key": "id"})


def _iso(ids: DataFrame, own: DataFrame, other: DataFrame, matched: DataFrame) -> DataFrame:
    """Ids whose surroundings in ``own`` agree with those of their counterpart in ``other``; ``matched`` has s, t, os, ot."""
    back = own.join(matched, (F.col("source") == F.col("s")) & (F.col("target") == F.col("t"))).select(F.col("source").alias("id"), F.col("os").alias("above"))
    ahead = own.join(matched, (F.col("source") == F.col("s")) & (F.col("target") == F.col("t"))).groupBy(F.col("target").alias("id")).agg(F.min_by("os", "source").alias("below"))
    here = ids.select("id").distinct().join(back, "id", "left").join(ahead, "id", "left").withColumn("node", F.coalesce("above", "below"))
    mine = _surroundings(here.select(F.col("id").alias("key"), F.col("id").alias("node")), own).withColumnRenamed("edges", "mine")
    theirs = _surroundings(here.filter("node is not null").select(F.col("id").alias("key"), "node"), other).withColumnRenamed("edges", "theirs")
    return mine.join(theirs, "key").mapInPandas(_agree, "id bigint")


def iso_divisions(gt, rec, matches: DataFrame, sparse: bool = True) -> DataFrame:
    """(kind, id): missed (fn) and false (fp) divisions that agree with their counterpart's surroundings."""
    forth = matches.select(F.col("x_source").alias("s"), F.col("x_target").alias("t"), F.col("y_source").alias("os"), F.col("y_target").alias("ot"))
    fro = forth.select(F.col("os").alias("s"), F.col("ot").alias("t"), F.col("s").alias("os"), F.col("t").alias("ot"))
    missed = fn_divisions(gt.edges, matches).filter("result <> 'tp'")
    fn = _iso(missed, gt.edges, rec.edges, forth).select(F.lit("fn").alias("kind"), "id")
    return fn.union(_iso(fp_divisions(rec.edges, matches, sparse), rec.edges, gt.edges, fro).select(F.lit("fp"), "id"))


def without_iso(errors: DataFrame, iso: DataFrame) -> DataFrame:
    """Edges (source, target) that touch none of the given divisions."""
    ids = iso.select(F.col("id").alias("_i")).distinct()
    return errors.join(ids, F.col("source") == F.col("_i"), "left_anti").join(ids, F.col("target") == F.col("_i"), "left_anti")
