"""Range joins and joins with nodes: the rows of a plain comparison, few copies, nothing gathered at the driver."""

import random

import pytest
from pyspark.sql import functions as F

from spoor.operators import filters, graph, objective, spatial


def placed(spark, n, seed):
    r = random.Random(seed)
    rows = [(i, r.randrange(3), r.uniform(-40, 40), float(r.randrange(-40, 40)), r.choice([-15.0, 0.0, 15.0, 30.0]), 1.0, -2.0, 0.5) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, t int, z double, y double, x double, mv_z double, mv_y double, mv_x double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("moved", [False, True])
def test_candidates_are_those_of_a_plain_comparison(spark, moved):
    rows, cells = placed(spark, 300, 3)
    found = {(r["source"], r["target"]): (r["distance"], r["prediction_distance"]) for r in spatial.candidate_edges(cells, 15.0, moved).collect()}
    d2 = lambda a, b, m: sum((a[k] + (a[k + 3] if m else 0) - b[k]) ** 2 for k in (2, 3, 4))
    wanted = {(a[0], b[0]): (d2(a, b, False) ** 0.5, d2(a, b, True) ** 0.5) for a in rows for b in rows if b[1] == a[1] - 1 and d2(a, b, moved) <= 225}
    assert found.keys() == wanted.keys() and len(wanted) > 100
    assert all(found[k] == pytest.approx(wanted[k]) for k in wanted)


def test_a_ball_is_copied_to_few_cells(spark):
    _, cells = placed(spark, 300, 4)
    found = spatial.range_join(spatial.points(cells, "a_"), spatial.points(cells, "b_"), 5.0, 5.0)
    copies = spatial.touched(spatial.points(cells, "a_"), 5.0).count()
    assert found.count() >= 300 and copies < 300 * 6


def test_large_sides_are_not_broadcast(spark):
    """Small tables, which Spark would broadcast by their size."""
    _, cells = placed(spark, 50, 5)
    edges = spatial.candidate_edges(cells, 15.0)
    flags = edges.select(F.lit(1).alias("param_id"), "source", "target", F.lit(True).alias("selected"))
    for df in (edges, filters.keep_incident(edges, cells), graph.validate(cells, edges), graph.selected_graph(cells, edges, flags, 1)[0], objective.pinned(edges, flags)):
        assert "BroadcastHashJoin" not in plan(df)


def test_rounds_of_components_do_not_multiply_estimates(spark):
    """The digits of the estimated size grew fourfold a round, until the driver's memory was used up."""
    from spoor.plans.components import connected_components

    path = spark.range(200).select((F.col("id") + 1).alias("a"), F.col("id").alias("b"))
    found = connected_components(path, few=-1)
    assert found.filter("component <> 0").isEmpty() and found.count() == 201
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**200


def test_constraints_read_edges_and_nodes_once(spark):
    """A union of a part for each family joined the candidate edges anew in each: nine merge joins for these rows."""
    _, cells = placed(spark, 50, 6)
    edges = spatial.candidate_edges(cells, 15.0)
    rows = objective.constraints(cells, edges, cell_state=True)
    assert plan(rows).count("SortMergeJoin ") == 1
    assert rows.count() == edges.count() * 13 + cells.count() * 9
    flags = edges.select("source", "target", (F.col("source") % 2 == 0).alias("selected"))
    found = objective.pinned(edges.filter("source < 10"), flags)
    assert {r["rhs"] for r in found.filter("cid % 2 = 0").collect()} == {1.0} and {r["rhs"] for r in found.filter("cid % 2 = 1").collect()} == {0.0}


def test_matching_makes_tracks_and_node_pairs_once(spark):
    """Each table of nodes and edges derived the tracks anew from the events, and each end of an edge made the pairs of nodes anew."""
    from pathlib import Path

    from spoor.operators import match
    from spoor.queries import _both, _coloured

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no given tables")
    g, r = _both(spark, data)
    for df in (g.nodes, g.edges, r.nodes, r.edges, *_coloured(spark, data)):
        assert not df.inputFiles()
    assert "Generate" not in plan(match.candidate_edge_pairs(g, r, 0.5))
