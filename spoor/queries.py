"""Registered queries over tables derived from the given ones, and the same in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.roi import Roi, close_to_border, frame_value, radius_value
from .operators import arrays, divisions, filters, graph, greedy, iso, match, metrics, objective, results, search, solve, spatial
from .plans import tracking
from .plans.components import cut
from .sources import store, tables, tracks_file
from .streaming import ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BOX = Roi((5, 10.0, 20.0, 50.0), (15, 70.0, 80.0, 250.0))
THRESHOLDS = {10: 12.0, 20: 15.0, -1: 18.0}
BASIC = objective.SolveParameters(track_cost=4.0, weight_edge_score=0.1, weight_node_score=-0.1, selection_constant=-1.0, max_cell_move=5.0, check_node_close_to_roi=True)
STATES = objective.SolveParameters(track_cost=4.0, weight_edge_score=0.1, weight_node_score=-0.1, selection_constant=-1.0, weight_division=-0.1, division_constant=1.0, weight_child=-0.2, weight_continuation=-0.3, cell_state=True, feature_func="square")

_CELLS = """cells AS (SELECT event_id AS id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, CAST(props->>'$.k' AS DOUBLE) AS z,
  CAST(user_id AS DOUBLE) AS y, value AS x, value / 500.0 AS score, CAST(event_id % 7 AS DOUBLE) - 3 AS mv_z, CAST(event_id % 5 AS DOUBLE) - 2 AS mv_y, CAST(event_id % 11 AS DOUBLE) - 5 AS mv_x FROM events)"""
_NEAR = _CELLS + """, near AS (SELECT a.id AS source, b.id AS target, a.t, sqrt((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) AS distance,
  sqrt((a.z+a.mv_z-b.z)*(a.z+a.mv_z-b.z)+(a.y+a.mv_y-b.y)*(a.y+a.mv_y-b.y)+(a.x+a.mv_x-b.x)*(a.x+a.mv_x-b.x)) AS prediction_distance
  FROM cells a JOIN cells b ON b.t = a.t - 1 WHERE {where})"""
_PLAIN = _NEAR.format(where="(a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x) <= 225.0")
_TRACKS = _CELLS + """, k AS (SELECT *, row_number() OVER (PARTITION BY y, t ORDER BY id) AS rk FROM cells QUALIFY rk <= 2),
tracks AS (SELECT k.t, k.z, k.y, k.x, k.id AS cell_id, coalesce(p.id, -1) AS parent_id, k.rk FROM k LEFT JOIN k p ON p.y = k.y AND p.t = k.t - 1 AND p.rk = 1),
gn AS (SELECT cell_id AS id, t, z, y, x FROM tracks), ge AS (SELECT cell_id AS source, parent_id AS target FROM tracks WHERE parent_id <> -1),
rn AS (SELECT cell_id + 1000000000 AS id, t, z, y, x + 0.25 AS x FROM tracks),
re AS (SELECT cell_id + 1000000000 AS source, parent_id + 1000000000 AS target FROM tracks WHERE parent_id <> -1 AND NOT (cell_id % 13 = 0 OR rk = 2 AND cell_id % 7 = 0))"""
_MATCH = _TRACKS + """, pairs AS (SELECT g.t AS frame, g.id AS x, r.id AS y, sqrt((g.z-r.z)*(g.z-r.z)+(g.y-r.y)*(g.y-r.y)+(g.x-r.x)*(g.x-r.x)) AS distance FROM gn g JOIN rn r ON g.t = r.t AND g.y = r.y
  WHERE (g.z-r.z)*(g.z-r.z)+(g.y-r.y)*(g.y-r.y)+(g.x-r.x)*(g.x-r.x) <= 0.25),
m AS (SELECT s.frame, g.source AS x_source, g.target AS x_target, r.source AS y_source, r.target AS y_target, s.distance + e.distance AS cost
  FROM ge g JOIN pairs s ON s.x = g.source JOIN re r ON r.source = s.y JOIN pairs e ON e.x = g.target AND e.y = r.target)"""
_FPD = """d AS (SELECT target AS parent, min(source) AS c1e, max(source) AS c2e FROM re GROUP BY target HAVING count(*) = 2),
fpd AS (SELECT d.parent AS id, a.x_target AS c1, b.x_target AS c2 FROM d LEFT JOIN m a ON a.y_source = d.c1e AND a.y_target = d.parent LEFT JOIN m b ON b.y_source = d.c2e AND b.y_target = d.parent
  WHERE NOT coalesce(a.x_target = b.x_target, false) AND (a.x_target IS NOT NULL OR b.x_target IS NOT NULL OR d.parent IN (SELECT y_source FROM m)))"""
_FND = """gd AS (SELECT target AS parent, min(source) AS c1e, max(source) AS c2e FROM ge GROUP BY target HAVING count(*) = 2),
fc AS (SELECT gd.parent AS id, g.target AS grand, a.y_target AS c1, b.y_target AS c2, p.y_source AS p FROM gd LEFT JOIN m a ON a.x_source = gd.c1e AND a.x_target = gd.parent LEFT JOIN m b ON b.x_source = gd.c2e AND b.x_target = gd.parent
  LEFT JOIN ge g ON g.source = gd.parent LEFT JOIN m p ON p.x_source = gd.parent AND p.x_target = g.target),
fnd AS (SELECT id, CASE WHEN coalesce(c1 = c2, false) AND (grand IS NULL OR coalesce(c1 = p, false)) THEN 'tp' WHEN grand IS NOT NULL AND coalesce(c1 = c2, false) THEN 'unconnected_parent'
  WHEN grand IS NOT NULL AND (coalesce(c1 = p, false) OR coalesce(c2 = p, false)) THEN 'unconnected_child' ELSE 'no_connection' END AS result,
  grand IS NOT NULL AND coalesce(c1 = c2, false) AND NOT coalesce(c1 = p, false) AS unconnected_parent FROM fc)"""
_IS = """sw AS (SELECT f.target AS id FROM (SELECT target, min(source) AS nxt FROM ge GROUP BY target HAVING count(*) = 1) f JOIN ge b ON b.source = f.target
  JOIN m mn ON mn.x_source = f.nxt AND mn.x_target = f.target JOIN m mp ON mp.x_source = f.target AND mp.x_target = b.target WHERE mn.y_target <> mp.y_source)"""
_FIXED = {"gt": "ge", "rec": "re"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace(", 6) AS ", ", 6) + 0.0 AS ").replace(", 6) FROM ", ", 6) + 0.0 FROM ")  # never minus zero
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rounded_signed(column: str, digits: int = 6):
    """Rounded as SQL's ROUND does, which leaves a negative number that rounds to zero its sign."""
    near = F.round(column, digits)
    return F.when((F.col(column) < 0) & (near == 0), F.lit(-0.0)).otherwise(near)


def _candidates(spark, sf_dir, **how) -> DataFrame:
    return spatial.candidate_edges(tables.cells(spark, sf_dir), how.pop("threshold", 15.0), how.pop("use_motion", False))


# ---- scans and filters ---------------------------------------------------


@query(f"WITH {_CELLS} SELECT * FROM cells")
def cells_scan(spark, sf_dir):
    return tables.cells(spark, sf_dir)


@query(f"WITH {_CELLS} SELECT CAST(min(t) AS DOUBLE) AS begin_t, CAST(max(t)+1 AS DOUBLE) AS end_t, " + ", ".join(f"CAST(floor(min({d})) AS DOUBLE) AS begin_{d}, CAST(ceil(max({d}))+1 AS DOUBLE) AS end_{d}" for d in "zyx") + " FROM cells")
def nodes_roi(spark, sf_dir):
    return tracks_file.bounds(tables.cells(spark, sf_dir), whole=True)


@query(f"WITH {_CELLS} SELECT id, t, z, y, x FROM cells WHERE t >= 5 AND t < 20 AND z >= 10 AND z < 80 AND y >= 20 AND y < 100 AND x >= 50 AND x < 300")
def roi_filter(spark, sf_dir):
    return tables.cells(spark, sf_dir).filter(BOX.contains()).select("id", "t", "z", "y", "x")


@query(f"WITH {_CELLS} SELECT t, count(*) AS n_cells, min(id) AS first_id, max(id) AS last_id FROM cells GROUP BY t")
def cells_by_frame(spark, sf_dir):
    return tables.cells(spark, sf_dir).groupBy("t").agg(F.count(F.lit(1)).alias("n_cells"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"WITH {_CELLS} SELECT id, CASE WHEN t < 10 THEN 12.0::DOUBLE WHEN t < 20 THEN 15.0::DOUBLE ELSE 18.0::DOUBLE END AS threshold, CASE WHEN t < 15 THEN 4.0::DOUBLE WHEN t < 40 THEN 6.0::DOUBLE END AS radius FROM cells")
def radius_lookup(spark, sf_dir):
    return tables.cells(spark, sf_dir).select("id", frame_value(F.col("t"), THRESHOLDS).alias("threshold"), radius_value(F.col("t"), F.lit(None), {15: 4.0, 40: 6.0}).alias("radius"))


@query(f"""WITH {_TRACKS}, c AS (SELECT parent_id, count(*) AS n FROM tracks WHERE parent_id <> -1 GROUP BY parent_id)
SELECT cell_id, tracks.parent_id, CASE WHEN a.n = 2 THEN 1 WHEN b.n = 2 THEN 2 ELSE 0 END AS div_state FROM tracks LEFT JOIN c a ON a.parent_id = cell_id LEFT JOIN c b ON b.parent_id = tracks.parent_id""")
def division_state(spark, sf_dir):
    return filters.division_state(tables.tracks_file(spark, sf_dir), allow_consecutive=True).select("cell_id", "parent_id", "div_state")


@query(f"WITH {_TRACKS} SELECT cell_id AS source, parent_id AS target FROM tracks WHERE parent_id <> -1 AND t >= 5 AND t < 20 AND x < 300 AND parent_id IN (SELECT cell_id FROM tracks WHERE t >= 5 AND t < 20 AND x < 300)")
def gt_edges_from_tracks(spark, sf_dir):
    return tracks_file.to_graph(tables.tracks_file(spark, sf_dir), Roi((5, 0.0, 0.0, 0.0), (15, None, None, 300.0))).edges


@query(f"WITH {_CELLS}, kept AS (SELECT id FROM cells WHERE score >= 0.25) SELECT source, target FROM ({'WITH ' + _PLAIN + ' SELECT * FROM near'}) WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)")
def low_score_clip(spark, sf_dir):
    return filters.clip_low_score(tables.cells(spark, sf_dir), _candidates(spark, sf_dir), 0.25)[1].select("source", "target")


@query(f"WITH {_CELLS} SELECT source, target FROM ({'WITH ' + _PLAIN + ' SELECT * FROM near'}) WHERE source % 9 <> 0 AND target % 9 <> 0")
def dangling_drop(spark, sf_dir):
    nodes = tables.cells(spark, sf_dir).withColumn("t", F.when(F.col("id") % 9 != 0, F.col("t")))
    return filters.drop_dangling(nodes, _candidates(spark, sf_dir))[1].select("source", "target")


@query(f"WITH {_CELLS} SELECT id FROM cells WHERE z-5.0 < 10 OR z+5.0 >= 80 OR y-5.0 < 20 OR y+5.0 >= 100 OR x-5.0 < 50 OR x+5.0 >= 300")
def border_cells(spark, sf_dir):
    return tables.cells(spark, sf_dir).filter(close_to_border(BOX, {-1: 8.0, 10: 5.0})).select("id")


@query(f"WITH {_CELLS} SELECT id, t AS begin, t + 3 AS \"end\" FROM cells WHERE (t + 3 < 6 OR t >= 9) AND (t + 3 < 20 OR t >= 21)")
def exclude_times(spark, sf_dir):
    rows = tables.cells(spark, sf_dir).select("id", F.col("t").alias("begin"), (F.col("t") + 3).alias("end"))
    return filters.exclude_times(rows, [(6, 9), (20, 21)])


@query(f"WITH {_CELLS} SELECT id, t, score FROM cells WHERE t = 7 AND z = 10")
def attribute_filter(spark, sf_dir):
    return filters.where_equal(tables.cells(spark, sf_dir), {"t": 7, "z": 10.0}).select("id", "t", "score")


@query(f"WITH {_CELLS} SELECT id, y FROM cells WHERE t = 3")
def one_frame(spark, sf_dir):
    return tables.cells(spark, sf_dir).filter(filters.is_frame(3)).select("id", "y")


@query(f"WITH {_CELLS} SELECT id, y, t FROM cells QUALIFY row_number() OVER (PARTITION BY y ORDER BY id DESC) = 1")
def latest_cells(spark, sf_dir):
    """The last row of each key."""
    return filters.latest_rows(tables.cells(spark, sf_dir), "y", "id").select("id", "y", "t")


@query(f"WITH {_CELLS} SELECT t, coalesce(CAST(ceil(avg(CASE WHEN t % 5 <> 0 AND id % 3 <> 0 THEN z / 10 END)) AS DOUBLE), 6.0::DOUBLE) AS radius FROM cells GROUP BY t")
def average_radius(spark, sf_dir):
    own = F.when((F.col("t") % 5 != 0) & (F.col("id") % 3 != 0), F.col("z") / 10)
    return arrays.average_radius(tables.cells(spark, sf_dir).withColumn("radius", own), 6.0)


# ---- range joins ---------------------------------------------------------


@query(f"WITH {_PLAIN} SELECT t, count(*) AS n_edges, round(avg(distance), 6) AS mean_distance FROM near GROUP BY t")
def candidate_edges(spark, sf_dir):
    return rounded(_candidates(spark, sf_dir).groupBy("t").agg(F.count(F.lit(1)).alias("n_edges"), F.avg("distance").alias("mean_distance")), "mean_distance")


@query("WITH " + _NEAR.format(where="(a.z+a.mv_z-b.z)*(a.z+a.mv_z-b.z)+(a.y+a.mv_y-b.y)*(a.y+a.mv_y-b.y)+(a.x+a.mv_x-b.x)*(a.x+a.mv_x-b.x) <= 225.0") + " SELECT source, target, t, round(distance, 6) AS distance, round(prediction_distance, 6) AS prediction_distance FROM near")
def candidate_edges_mv(spark, sf_dir):
    return rounded(_candidates(spark, sf_dir, use_motion=True), "distance", "prediction_distance")


_BY_FRAME = "CASE WHEN a.t < 10 THEN 144.0 WHEN a.t < 20 THEN 225.0 ELSE 324.0 END"


@query("WITH " + _NEAR.format(where=f"(a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x) <= {_BY_FRAME}") + " SELECT source, target, round(distance, 6) AS distance FROM near")
def candidate_edges_threshold_map(spark, sf_dir):
    return rounded(_candidates(spark, sf_dir, threshold=THRESHOLDS).select("source", "target", "distance"), "distance")


_SELECTED = _PLAIN + ", sel AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY distance, target) = 1 AS selected FROM near)"


def _selections(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("source").orderBy("distance", "target")
    return _candidates(spark, sf_dir).select(F.lit(1).alias("param_id"), "source", "target", "distance", (F.row_number().over(order) == 1).alias("selected"))


@query(f"WITH {_SELECTED} SELECT id FROM cells WHERE id IN (SELECT source FROM sel WHERE selected) OR id IN (SELECT target FROM sel WHERE selected)")
def selected_graph(spark, sf_dir):
    flags = _selections(spark, sf_dir)
    return graph.selected_graph(tables.cells(spark, sf_dir), flags.select("source", "target"), flags, 1)[0].select("id")


@query(f"WITH {_SELECTED} SELECT source, target, selected FROM sel WHERE source NOT IN (SELECT id FROM cells WHERE t >= 5 AND t < 20 AND z >= 10 AND z < 80 AND y >= 20 AND y < 100 AND x >= 50 AND x < 300)")
def reset_selection(spark, sf_dir):
    return store.reset(_selections(spark, sf_dir), tables.cells(spark, sf_dir).filter(BOX.contains()), [1]).select("source", "target", "selected")


_BALL = "(g.z-c.z)*(g.z-c.z)+(g.y-c.y)*(g.y-c.y)+(g.x-c.x)*(g.x-c.x) <= 9.0"


@query(f"WITH {_TRACKS}, cand AS (SELECT * FROM cells WHERE id % 3 <> 0 AND score >= 0.1) SELECT count(*) FILTER (EXISTS (SELECT 1 FROM cand c WHERE c.t = g.t AND {_BALL})) AS matches, count(*) AS total FROM gn g")
def node_recall(spark, sf_dir):
    return spatial.node_recall(tables.cells(spark, sf_dir).filter("id % 3 <> 0"), tables.gt(spark, sf_dir).nodes, 3.0, 0.1)


@query(f"""WITH {_TRACKS}, cand AS (SELECT * FROM cells WHERE id % 3 <> 0), near AS (SELECT g.id, c.z, c.y, c.x FROM gn g JOIN cand c ON c.t = g.t AND {_BALL}),
hit AS (SELECT DISTINCT e.source, e.target FROM ge e JOIN near a ON a.id = e.source JOIN near b ON b.id = e.target WHERE (a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x) < 2500.0)
SELECT (SELECT count(*) FROM hit) AS matches, (SELECT count(*) FROM ge) AS total""")
def edge_recall(spark, sf_dir):
    g = tables.gt(spark, sf_dir)
    return spatial.edge_recall(tables.cells(spark, sf_dir).filter("id % 3 <> 0"), g.nodes, g.edges, 3.0, 50.0)


# ---- objective and constraints -------------------------------------------

_FREE = "t = (SELECT min(t) FROM cells)"
_CLOSE = "z-5.0 < 10 OR z+5.0 >= 80 OR y-5.0 < 20 OR y+5.0 >= 100 OR x-5.0 < 50 OR x+5.0 >= 300"
_NONE = "CAST(-1 AS BIGINT) AS other"


@query(f"""WITH {_PLAIN} SELECT 'node_selected' AS kind, id, {_NONE}, round(score * -0.1::DOUBLE + -1.0::DOUBLE, 6) AS coef FROM cells
UNION ALL SELECT 'node_appear', id, -1, CASE WHEN {_FREE} OR {_CLOSE} THEN 0.0::DOUBLE ELSE 4.0::DOUBLE END FROM cells UNION ALL SELECT 'node_split', id, -1, 1.0::DOUBLE FROM cells
UNION ALL SELECT 'edge_selected', source, target, round(prediction_distance * 0.1::DOUBLE, 6) FROM near""")
def objective_basic(spark, sf_dir):
    return rounded(objective.objective(tables.cells(spark, sf_dir), _candidates(spark, sf_dir), BASIC, BOX).fillna(-1, ["other"]), "coef")


LOGS = objective.SolveParameters(track_cost=4.0, weight_edge_score=0.1, weight_node_score=-0.1, selection_constant=-1.0, feature_func="log")


@query(f"""WITH {_PLAIN} SELECT 'node_selected' AS kind, id, {_NONE}, CASE WHEN score > 0 THEN round(ln(score) * -0.1::DOUBLE + -1.0::DOUBLE, 6) ELSE 'Infinity'::DOUBLE END AS coef FROM cells
UNION ALL SELECT 'node_appear', id, -1, CASE WHEN {_FREE} THEN 0.0::DOUBLE ELSE 4.0::DOUBLE END FROM cells UNION ALL SELECT 'node_split', id, -1, 1.0::DOUBLE FROM cells
UNION ALL SELECT 'edge_selected', source, target, CASE WHEN prediction_distance > 0 THEN round(ln(prediction_distance) * 0.1::DOUBLE, 6) ELSE '-Infinity'::DOUBLE END FROM near""")
def objective_log(spark, sf_dir):
    return objective.objective(tables.cells(spark, sf_dir), _candidates(spark, sf_dir), LOGS).fillna(-1, ["other"]).withColumn("coef", rounded_signed("coef"))


def _with_states(cells: DataFrame) -> DataFrame:
    return cells.withColumn("score_mother", F.col("z") / 100).withColumn("score_daughter", F.col("score") / 2).withColumn("score_continuation", 1 - F.col("score"))


@query(f"""WITH {_PLAIN} SELECT 'node_selected' AS kind, id, {_NONE}, round(score*score * -0.1::DOUBLE + -1.0::DOUBLE, 12) + 0.0 AS coef FROM cells
UNION ALL SELECT 'node_appear', id, -1, CASE WHEN {_FREE} THEN 0.0::DOUBLE ELSE 4.0::DOUBLE END FROM cells UNION ALL SELECT 'node_split', id, -1, round((z/100)*(z/100) * -0.1::DOUBLE + 1.0::DOUBLE, 12) + 0.0 FROM cells
UNION ALL SELECT 'node_child', id, -1, round((score/2)*(score/2) * -0.2::DOUBLE, 12) + 0.0 FROM cells UNION ALL SELECT 'node_continuation', id, -1, round((1-score)*(1-score) * -0.3::DOUBLE, 12) + 0.0 FROM cells
UNION ALL SELECT 'edge_selected', source, target, round(prediction_distance*prediction_distance * 0.1::DOUBLE, 12) + 0.0 FROM near""")
def objective_cell_state(spark, sf_dir):
    return rounded(objective.objective(_with_states(tables.cells(spark, sf_dir)), _candidates(spark, sf_dir), STATES).fillna(-1, ["other"]), "coef", digits=12)


def _rows(family, table, cid, other, kind, i, o, coef, rel, rhs):
    return f"SELECT '{family}' AS family, {cid} AS cid, coalesce(CAST({other} AS BIGINT), -1) AS cid_other, '{kind}' AS kind, {i} AS id, coalesce(CAST({o} AS BIGINT), -1) AS other, {coef}.0::DOUBLE AS coef, '{rel}' AS relation, {rhs}.0::DOUBLE AS rhs FROM {table}"


_BASIC_ROWS = " UNION ALL ".join(
    _rows(*r) for r in (
        ("edge_endpoints", "near", "source", "target", "edge_selected", "source", "target", 2, "<=", 0), ("edge_endpoints", "near", "source", "target", "node_selected", "source", "NULL", -1, "<=", 0),
        ("edge_endpoints", "near", "source", "target", "node_selected", "target", "NULL", -1, "<=", 0), ("one_predecessor", "near", "source", "NULL", "edge_selected", "source", "target", 1, "=", 0),
        ("one_predecessor", "cells", "id", "NULL", "node_appear", "id", "NULL", 1, "=", 0), ("one_predecessor", "cells", "id", "NULL", "node_selected", "id", "NULL", -1, "=", 0),
        ("two_successors", "near", "target", "NULL", "edge_selected", "source", "target", 1, "<=", 0), ("two_successors", "cells", "id", "NULL", "node_selected", "id", "NULL", -2, "<=", 0),
        ("split_upper", "near", "target", "NULL", "edge_selected", "source", "target", 1, "<=", 1), ("split_upper", "cells", "id", "NULL", "node_split", "id", "NULL", -1, "<=", 1),
        ("split_lower", "near", "target", "NULL", "edge_selected", "source", "target", 1, ">=", 0), ("split_lower", "cells", "id", "NULL", "node_split", "id", "NULL", -2, ">=", 0),
    )
)
_STATE_ROWS = " UNION ALL ".join(
    [_rows("one_state", "cells", "id", "NULL", k, "id", "NULL", c, "=", 0) for k, c in (("node_split", 1), ("node_child", 1), ("node_continuation", 1), ("node_selected", -1))]
    + [_rows("split_child", "near", "source", "target", k, i, o, c, "<=", 1) for k, i, o, c in (("node_child", "source", "NULL", 1), ("edge_selected", "source", "target", 1), ("node_split", "target", "NULL", -1))]
    + [_rows("child_split", "near", "source", "target", k, i, o, c, "<=", 1) for k, i, o, c in (("node_split", "target", "NULL", 1), ("edge_selected", "source", "target", 1), ("node_child", "source", "NULL", -1))]
)


@query(f"WITH {_PLAIN} {_BASIC_ROWS}")
def constraints_basic(spark, sf_dir):
    return objective.constraints(tables.cells(spark, sf_dir), _candidates(spark, sf_dir)).fillna(-1, ["other", "cid_other"])


@query(f"WITH {_PLAIN} {_BASIC_ROWS} UNION ALL {_STATE_ROWS}")
def constraints_cell_state(spark, sf_dir):
    return objective.constraints(tables.cells(spark, sf_dir), _candidates(spark, sf_dir), cell_state=True).fillna(-1, ["other", "cid_other"])


@query(f"WITH {_SELECTED} SELECT 'pinned' AS family, source AS cid, target AS cid_other, 'edge_selected' AS kind, source AS id, target AS other, 1.0::DOUBLE AS coef, '=' AS relation, CASE WHEN selected THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rhs FROM sel WHERE source % 2 = 0")
def constraints_pinned(spark, sf_dir):
    return objective.pinned(_candidates(spark, sf_dir), _selections(spark, sf_dir).filter("source % 2 = 0"))


@query(f"""WITH {_PLAIN}, o AS (SELECT 'edge_selected' AS kind, source AS id, target AS other FROM near UNION ALL SELECT k, id, NULL FROM cells, (VALUES ('node_selected'), ('node_appear'), ('node_split')) v(k))
SELECT kind, id, coalesce(other, -1) AS other, row_number() OVER (ORDER BY kind, id NULLS FIRST, other NULLS FIRST) - 1 AS var FROM o""")
def indicators(spark, sf_dir):
    return objective.indicators(objective.objective(tables.cells(spark, sf_dir), _candidates(spark, sf_dir), BASIC, BOX).select("kind", "id", "other")).fillna(-1, ["other"])


# ---- graphs --------------------------------------------------------------


@query(f"WITH {_TRACKS} SELECT id, (SELECT count(*) FROM ge WHERE source = id) AS n_prev, (SELECT count(*) FROM ge WHERE target = id) AS n_next FROM gn")
def degree_stats(spark, sf_dir):
    g = tables.gt(spark, sf_dir)
    return graph.degrees(g.nodes, g.edges)


@query(f"WITH {_PLAIN} SELECT source AS id, 'parents' AS what, count(*) AS n FROM near GROUP BY source HAVING count(*) > 1 UNION ALL SELECT target, 'children', count(*) FROM near GROUP BY target HAVING count(*) > 2")
def track_validity(spark, sf_dir):
    return filters.assert_tracks(_candidates(spark, sf_dir))


@query(f"WITH {_PLAIN} SELECT (SELECT min(t) FROM cells) AS begin, (SELECT max(t) + 1 FROM cells) AS \"end\", (SELECT count(*) FROM near a JOIN cells s ON s.id = a.source JOIN cells e ON e.id = a.target WHERE s.t <= e.t) AS backward")
def graph_frames(spark, sf_dir):
    return graph.validate(tables.cells(spark, sf_dir), _candidates(spark, sf_dir))


@query(f"WITH {_TRACKS} SELECT target AS parent, min(source) AS child1, max(source) AS child2 FROM ge GROUP BY target HAVING count(*) = 2")
def division_nodes(spark, sf_dir):
    return graph.divisions(tables.gt(spark, sf_dir).edges)


_WALK = _TRACKS + ", w AS (SELECT id, id AS root FROM gn WHERE id NOT IN (SELECT source FROM ge) UNION ALL SELECT ge.source, w.root FROM w JOIN ge ON ge.target = w.id), tr AS (SELECT id, min(id) OVER (PARTITION BY root) AS track FROM w)"


@query(f"WITH RECURSIVE {_WALK} SELECT * FROM tr")
def tracks_components(spark, sf_dir):
    g = tables.gt(spark, sf_dir, often=True)
    return graph.tracks(g.nodes, g.edges)


@query(f"WITH RECURSIVE {_WALK} SELECT track, count(*) AS n_nodes, min(t) AS first_frame, max(t) AS last_frame FROM tr JOIN gn USING (id) GROUP BY track")
def track_lengths(spark, sf_dir):
    g = tables.gt(spark, sf_dir, often=True)
    return graph.track_lengths(g.nodes, g.edges)


def _chains(e: str) -> str:
    return f"""{e}d AS (SELECT target AS id FROM {e} GROUP BY target HAVING count(*) = 2),
{e}c AS (SELECT source AS first, source, target FROM {e} WHERE target IN (SELECT id FROM {e}d) OR target NOT IN (SELECT source FROM {e})
  UNION ALL SELECT c.first, n.source, n.target FROM {e}c c JOIN {e} n ON n.target = c.source WHERE c.source NOT IN (SELECT id FROM {e}d))"""


@query(f"WITH RECURSIVE {_TRACKS}, {_chains('ge')} SELECT first AS first_source, arg_max(source, gn.t) AS last_source, count(*) AS n_edges FROM gec JOIN gn ON gn.id = source GROUP BY first")
def split_at_divisions(spark, sf_dir):
    g = tables.gt(spark, sf_dir, often=True)
    rows = graph.segments(g.edges).join(g.nodes.select(F.col("id").alias("source"), "t"), "source")
    return rows.groupBy("segment").agg(F.min_by("source", "t").alias("first_source"), F.max_by("source", "t").alias("last_source"), F.count(F.lit(1)).alias("n_edges")).drop("segment")


# ---- matching and metrics ------------------------------------------------


def _both(spark, sf_dir):
    return tables.both(spark, sf_dir)


def _matched(spark, sf_dir):
    g, r = _both(spark, sf_dir)
    found, false = match.match_edges(g, r, 0.5)
    return g, r, found, false


@query(f"WITH {_MATCH} SELECT frame, x, y, round(distance, 6) AS distance FROM pairs")
def node_pairs(spark, sf_dir):
    g, r = _both(spark, sf_dir)
    return rounded(spatial.node_pairs(g.nodes, r.nodes, 0.5), "distance")


@query(f"WITH {_MATCH} SELECT frame, x_source, x_target, y_source, y_target, round(cost, 6) AS cost FROM m")
def edge_costs(spark, sf_dir):
    return rounded(match.candidate_edge_pairs(*_both(spark, sf_dir), 0.5).select("frame", "x_source", "x_target", "y_source", "y_target", "cost"), "cost")


@query(f"WITH {_MATCH} SELECT x_source, x_target, y_source, y_target, round(cost, 6) AS cost FROM m")
def edge_matches(spark, sf_dir):
    return rounded(_matched(spark, sf_dir)[2], "cost")


@query(None)
def edge_matches_ambiguous(spark, sf_dir):
    """Threshold 5: some edges have several candidates, so the assignment decides."""
    return rounded(match.match_edges(*_both(spark, sf_dir), 5.0)[0], "cost")


@query(f"WITH {_MATCH} SELECT x, y, round(distance, 6) AS cost FROM pairs")
def node_matches(spark, sf_dir):
    g, r = _both(spark, sf_dir)
    return rounded(match.match_nodes(g.nodes, r.nodes, 0.5), "cost")


@query(f"""WITH RECURSIVE {_MATCH}, w AS (SELECT id, id AS root FROM gn WHERE id NOT IN (SELECT source FROM ge) UNION ALL SELECT ge.source, w.root FROM w JOIN ge ON ge.target = w.id), tr AS (SELECT id, min(id) OVER (PARTITION BY root) AS track FROM w),
v AS (SELECT id, id AS root FROM rn WHERE id NOT IN (SELECT source FROM re) UNION ALL SELECT re.source, v.root FROM v JOIN re ON re.target = v.id), ur AS (SELECT id, min(id) OVER (PARTITION BY root) AS track FROM v)
SELECT g.track AS gt_track, string_agg(DISTINCT CAST(r.track AS VARCHAR), ',' ORDER BY CAST(r.track AS VARCHAR)) AS rec_tracks FROM m JOIN tr g ON g.id = x_source JOIN ur r ON r.id = y_source GROUP BY g.track""")
def track_matches(spark, sf_dir):
    g, r, m, _ = _matched(spark, sf_dir)
    return metrics.track_matches(g, r, m).select("gt_track", F.array_join(F.array_sort(F.col("rec_tracks").cast("array<string>")), ",").alias("rec_tracks"))


@query(f"WITH {_MATCH} SELECT source, target FROM re EXCEPT SELECT y_source, y_target FROM m")
def fp_edges(spark, sf_dir):
    _, r, m, _ = _matched(spark, sf_dir)
    return metrics.fp_edges(r.edges, m)


@query(f"WITH {_MATCH} SELECT source, target FROM ge EXCEPT SELECT x_source, x_target FROM m")
def fn_edges(spark, sf_dir):
    g, _, m, _ = _matched(spark, sf_dir)
    return metrics.fn_edges(g.edges, m)


@query(f"WITH {_MATCH}, {_IS} SELECT id FROM sw")
def identity_switches(spark, sf_dir):
    g, _, m, _ = _matched(spark, sf_dir)
    return metrics.identity_switches(g.edges, m)


@query(f"WITH {_MATCH}, {_FPD} SELECT id, coalesce(c1, -1) AS c1, coalesce(c2, -1) AS c2 FROM fpd")
def fp_divisions(spark, sf_dir):
    _, r, m, _ = _matched(spark, sf_dir)
    return metrics.fp_divisions(r.edges, m).fillna(-1)


@query(f"""WITH {_MATCH}, d AS (SELECT target AS parent, min(source) AS c1e, max(source) AS c2e FROM ge GROUP BY target HAVING count(*) = 2)
SELECT d.parent AS id, coalesce(a.y_target, -1) AS c1, coalesce(b.y_target, -1) AS c2 FROM d LEFT JOIN m a ON a.x_source = c1e AND a.x_target = d.parent LEFT JOIN m b ON b.x_source = c2e AND b.x_target = d.parent
WHERE NOT coalesce(a.y_target = b.y_target, false) AND (a.y_target IS NOT NULL OR b.y_target IS NOT NULL OR d.parent IN (SELECT x_source FROM m WHERE y_source IN (SELECT target FROM re)))""")
def fp_divisions_open_end(spark, sf_dir):
    """The whole annotation against its part with missing edges; divisions where that part's track ends are left out."""
    whole, part = _both(spark, sf_dir)
    matches, _ = match.match_edges(part, whole, 0.5)
    return metrics.fp_divisions(whole.edges, cut(matches), gt_edges=part.edges).fillna(-1)


@query(f"WITH {_MATCH}, {_FND} SELECT id, result, unconnected_parent FROM fnd")
def fn_divisions(spark, sf_dir):
    g, _, m, _ = _matched(spark, sf_dir)
    return metrics.fn_divisions(g.edges, m)


@query(f"""WITH {_MATCH}, n AS (SELECT (SELECT count(*) FROM ge) AS g, (SELECT count(*) FROM m) AS m), f AS (SELECT m, g, m / CAST(g AS DOUBLE) AS recall, 1.0::DOUBLE AS precision FROM n)
SELECT g AS gt_edges, m AS matched_edges, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f_score FROM f""")
def f_score(spark, sf_dir):
    g, _, m, false = _matched(spark, sf_dir)
    one = g.edges.agg(F.count(F.lit(1)).alias("gt_edges")).join(m.agg(F.count(F.lit(1)).alias("matched_edges"))).join(false.agg(F.count(F.lit(1)).alias("fp")))
    return rounded(one.select("gt_edges", "matched_edges", *metrics.f_score(F.col("gt_edges"), F.col("matched_edges") + F.col("fp"), F.col("matched_edges"))), "precision", "recall", "f_score")


@query(f"""WITH RECURSIVE {_MATCH}, {_FPD}, kept AS (SELECT y_source AS source, y_target AS target FROM m), cuts AS (SELECT id FROM fpd WHERE id IN (SELECT source FROM kept) AND id IN (SELECT target FROM kept)),
p AS (SELECT source, target, target AS root FROM kept WHERE target NOT IN (SELECT source FROM kept) OR target IN (SELECT id FROM cuts) UNION ALL SELECT k.source, k.target, p.root FROM p JOIN kept k ON k.target = p.source WHERE p.source NOT IN (SELECT id FROM cuts)),
n AS (SELECT root, count(*) AS n FROM p GROUP BY root) SELECT round(avg(n), 6) AS aeftl, round(sum(n * n) / CAST((SELECT count(*) FROM ge) AS DOUBLE), 6) AS erl FROM n""")
def aeftl_erl(spark, sf_dir):
    g, r, m, _ = _matched(spark, sf_dir)
    return rounded(metrics.aeftl_erl(g.edges, r.edges, m, metrics.fp_divisions(r.edges, m)), "aeftl", "erl")


@query(f"""WITH RECURSIVE {_MATCH}, {_FPD}, {_FND}, {_IS}, fe AS (SELECT source, target FROM ge EXCEPT SELECT x_source, x_target FROM m),
bn AS (SELECT id FROM sw UNION SELECT id FROM fnd WHERE result IN ('no_connection', 'unconnected_child') UNION SELECT c1 FROM fpd WHERE c1 IS NOT NULL UNION SELECT c2 FROM fpd WHERE c2 IS NOT NULL),
t0 AS (SELECT g.source, g.target, CASE WHEN fe.source IS NULL THEN 0 ELSE 1 END AS be, CASE WHEN bn.id IS NULL THEN 0 ELSE 1 END AS bn FROM ge g LEFT JOIN fe ON fe.source = g.source AND fe.target = g.target LEFT JOIN bn ON bn.id = g.source),
wk AS (SELECT source AS s, target AS p, source AS pos, 1 AS depth, be AS bad, bn AS thr FROM t0 UNION ALL SELECT w.s, w.p, t0.source, w.depth + 1, greatest(w.bad, w.thr, t0.be), t0.bn FROM wk w JOIN t0 ON t0.target = w.pos WHERE w.depth < 5),
b AS (SELECT s, p, depth, max(bad) AS bad FROM wk GROUP BY s, p, depth), c AS (SELECT depth, max(bad) OVER (PARTITION BY s, p ORDER BY depth) AS bad FROM b)
SELECT CAST(d AS INTEGER) AS depth, count(c.depth) FILTER (bad = 0) AS correct, count(c.depth) AS total FROM range(1, 6) r(d) LEFT JOIN c ON c.depth = d GROUP BY d""")
def perfect_segments(spark, sf_dir):
    g, r, m, _ = _matched(spark, sf_dir)
    m = cut(m)
    fnd = metrics.fn_divisions(g.edges, m).filter("result in ('no_connection', 'unconnected_child')").select("id")
    fpd = metrics.fp_divisions(r.edges, m).select(F.explode(F.array("c1", "c2")).alias("id")).filter("id is not null")
    return metrics.perfect_segments(g.edges, metrics.fn_edges(g.edges, m), metrics.identity_switches(g.edges, m).union(fnd).union(fpd), 5)


def _pieces(e: str, n: str) -> str:
    return f"{_chains(e)}, {e}p AS (SELECT first, t, z, y, x FROM {e}c JOIN {n} ON {n}.id = source UNION ALL SELECT first, t, z, y, x FROM {e}c JOIN {n} ON {n}.id = target WHERE source = first), {e}n AS (SELECT first, count(*) AS n FROM {e}p GROUP BY first)"


@query(f"""WITH RECURSIVE {_TRACKS}, {_pieces('ge', 'gn')}, {_pieces('re', 'rn')},
c AS (SELECT a.first AS g, b.first AS r, count(*) AS c, sum(1.0::DOUBLE / (1.0::DOUBLE + exp(-(ln(9999.0::DOUBLE) / 50) * (sqrt((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) - 50)))) AS d FROM gep a JOIN rep b ON a.t = b.t GROUP BY 1, 2),
s AS (SELECT g, min(gn.n + rn.n - 2 * c + d) AS near FROM c JOIN gen gn ON gn.first = g JOIN ren rn ON rn.first = r GROUP BY g),
o AS (SELECT round(least(coalesce(near, 1e300), n + (SELECT min(n) FROM ren)), 6) AS score FROM gen LEFT JOIN s ON s.g = first) SELECT score, count(*) AS n_tracks FROM o GROUP BY score""")
def validation_score(spark, sf_dir):
    g, r = _both(spark, sf_dir)
    found = metrics.validation_score(metrics.split_tracks(g.nodes, g.edges), metrics.split_tracks(r.nodes, r.edges))
    return rounded(found, "score").groupBy("score").agg(F.count(F.lit(1)).alias("n_tracks"))


def _user_tracks(spark, sf_dir, rank: int) -> DataFrame:
    """(track, t, z, y, x): a user's cells of one rank by day; days without one are gaps."""
    return tables.tracks_file(spark, sf_dir).filter(F.col("rk") == rank).select(F.col("y").cast("bigint").alias("track"), "t", "z", "y", "x")


@query(f"""WITH {_CELLS}, k AS (SELECT CAST(y AS BIGINT) AS track, t, z, y, x, row_number() OVER (PARTITION BY y, t ORDER BY id) AS rk FROM cells),
g AS (SELECT * FROM k WHERE rk = 1), r AS (SELECT * FROM k WHERE rk = 2), gh AS (SELECT track, min(t) AS f, count(*) AS n FROM g GROUP BY track), rh AS (SELECT track, min(t) AS f, count(*) AS n FROM r GROUP BY track),
p AS (SELECT gh.track AS gt, rh.track AS rt, gh.n AS gn, rh.n AS rn, gh.f <= rh.f AS g_first FROM gh, rh),
a AS (SELECT gt, rt, r.t FROM p JOIN r ON g_first AND r.track = rt LEFT JOIN g ON g.track = gt AND g.t = r.t WHERE g.t IS NULL
  UNION ALL SELECT gt, rt, g.t FROM p JOIN g ON NOT g_first AND g.track = gt LEFT JOIN r ON r.track = rt AND r.t = g.t WHERE r.t IS NULL),
s AS (SELECT gt, rt, min(t) AS stop FROM a GROUP BY gt, rt),
c AS (SELECT p.gt, p.rt, count(*) AS c, sum(1.0::DOUBLE / (1.0::DOUBLE + exp(-(ln(9999.0::DOUBLE) / 50) * (sqrt((g.z-r.z)*(g.z-r.z)+(g.y-r.y)*(g.y-r.y)+(g.x-r.x)*(g.x-r.x)) - 50)))) AS d
  FROM p LEFT JOIN s ON s.gt = p.gt AND s.rt = p.rt JOIN g ON g.track = p.gt JOIN r ON r.track = p.rt AND r.t = g.t WHERE s.stop IS NULL OR g.t < s.stop GROUP BY p.gt, p.rt)
SELECT p.gt AS track, round(min(gn + rn - 2 * coalesce(c, 0) + coalesce(d, 0.0)), 6) AS score FROM p LEFT JOIN c ON c.gt = p.gt AND c.rt = p.rt GROUP BY p.gt""")
def validation_score_gaps(spark, sf_dir):
    """Tracks with gaps: each user's first cell of a day against the users' second cells."""
    return rounded(metrics.validation_score(_user_tracks(spark, sf_dir, 1), _user_tracks(spark, sf_dir, 2)), "score")


_REPORT = """SELECT {k} AS leniency, g AS gt_total, r AS rec_total, {fp} AS fp, {fn} AS fn, round((r - {fp}) / CAST(nullif(r, 0) AS DOUBLE), 6) AS precision, round((g - {fn}) / CAST(nullif(g, 0) AS DOUBLE), 6) AS recall,
round(2 * ((r - {fp}) / CAST(nullif(r, 0) AS DOUBLE)) * ((g - {fn}) / CAST(nullif(g, 0) AS DOUBLE)) / nullif((r - {fp}) / CAST(nullif(r, 0) AS DOUBLE) + (g - {fn}) / CAST(nullif(g, 0) AS DOUBLE), 0), 6) AS f1 FROM n"""


@query(f"""WITH {_MATCH}, gp AS (SELECT * FROM gn WHERE id IN (SELECT target FROM ge GROUP BY target HAVING count(*) = 2)), rp AS (SELECT * FROM rn WHERE id IN (SELECT target FROM re GROUP BY target HAVING count(*) = 2)),
h AS (SELECT x, y FROM pairs WHERE frame = 10 AND x IN (SELECT id FROM gp) AND y IN (SELECT id FROM rp)),
n AS (SELECT (SELECT count(*) FROM gp WHERE t = 10) AS g, (SELECT count(*) FROM rp WHERE t = 10) AS r, (SELECT count(*) FROM h) AS h)
{_REPORT.format(k=0, fp='(r - h)', fn='(g - h)')} UNION ALL {_REPORT.format(k=1, fp='(r - h)', fn='(g - h)')}""")
def division_report(spark, sf_dir):
    g, r = _both(spark, sf_dir)
    at = lambda one: one.nodes.join(graph.divisions(one.edges).select(F.col("parent").alias("id")), "id", "left_semi")
    return rounded(divisions.division_reports(at(g), at(r), 10, 0.5, 1), "precision", "recall", "f1")


@query(f"""WITH {_MATCH} SELECT coalesce(frame, -1) AS frame, count(*) AS n, round(avg(distance), 6) AS avg_distance, round(median(distance), 6) AS median_distance, round(min(distance), 6) AS min_distance, round(max(distance), 6) AS max_distance FROM pairs GROUP BY GROUPING SETS ((pairs.frame), ())""")
def match_distance_stats(spark, sf_dir):
    g, r = _both(spark, sf_dir)
    found = match.match_nodes(g.nodes, r.nodes, 0.5).join(g.nodes.select(F.col("id").alias("x"), F.col("t").alias("frame")), "x").select("frame", F.col("cost").alias("distance"))
    return rounded(match.distance_stats(found).fillna(-1, ["frame"]), "avg_distance", "median_distance", "min_distance", "max_distance")


@query(f"""WITH RECURSIVE {_MATCH}, {_FPD}, {_FND}, {_IS}, w AS (SELECT id, id AS root FROM gn WHERE id NOT IN (SELECT source FROM ge) UNION ALL SELECT ge.source, w.root FROM w JOIN ge ON ge.target = w.id),
v AS (SELECT id, id AS root FROM rn WHERE id NOT IN (SELECT source FROM re) UNION ALL SELECT re.source, v.root FROM v JOIN re ON re.target = v.id),
kept AS (SELECT y_source AS source, y_target AS target FROM m), cuts AS (SELECT id FROM fpd WHERE id IN (SELECT source FROM kept) AND id IN (SELECT target FROM kept)),
p AS (SELECT source, target, target AS root FROM kept WHERE target NOT IN (SELECT source FROM kept) OR target IN (SELECT id FROM cuts) UNION ALL SELECT k.source, k.target, p.root FROM p JOIN kept k ON k.target = p.source WHERE p.source NOT IN (SELECT id FROM cuts)),
n AS (SELECT root, count(*) AS n FROM p GROUP BY root),
c AS (SELECT (SELECT count(*) FROM ge) AS gt_edges, (SELECT count(*) FROM re) AS rec_edges, (SELECT count(*) FROM m) AS matched_edges)
SELECT (SELECT count(DISTINCT target) FROM ge WHERE target NOT IN (SELECT source FROM ge)) AS gt_tracks, (SELECT count(DISTINCT target) FROM re WHERE target NOT IN (SELECT source FROM re)) AS rec_tracks,
  (SELECT count(DISTINCT root) FROM m JOIN w ON id = x_source) AS gt_matched_tracks, (SELECT count(DISTINCT root) FROM m JOIN v ON id = y_source) AS rec_matched_tracks, gt_edges, rec_edges, matched_edges,
  CAST(0 AS BIGINT) AS fp_edges, gt_edges - matched_edges AS fn_edges, (SELECT count(*) FROM sw) AS identity_switches, (SELECT count(*) FROM fpd) AS fp_divisions, (SELECT count(*) FROM fnd WHERE result <> 'tp') AS fn_divisions,
  CAST(0 AS BIGINT) AS iso_fn_divisions, CAST(0 AS BIGINT) AS iso_fp_divisions, (SELECT count(*) FROM fnd) AS gt_divisions, (SELECT count(*) FROM fnd WHERE result = 'no_connection') AS fn_divs_no_connections,
  (SELECT count(*) FROM fnd WHERE result = 'unconnected_child') AS fn_divs_unconnected_child, (SELECT count(*) FROM fnd WHERE unconnected_parent) AS fn_divs_unconnected_parent,
  (SELECT round(avg(n), 6) FROM n) AS aeftl, (SELECT round(sum(n * n) / CAST((SELECT count(*) FROM ge) AS DOUBLE), 6) FROM n) AS erl, 1.0::DOUBLE AS precision, round(matched_edges / CAST(gt_edges AS DOUBLE), 6) AS recall,
  round(2 * (matched_edges / CAST(gt_edges AS DOUBLE)) / (1.0::DOUBLE + matched_edges / CAST(gt_edges AS DOUBLE)), 6) AS f_score FROM c""")
def evaluation_scores(spark, sf_dir):
    """The numbers of ``evaluation`` without its windows, which ``perfect_segments`` has."""
    return rounded(tracking.evaluate(*_both(spark, sf_dir), 0.5).drop("correct_segments"), "aeftl", "erl", "precision", "recall", "f_score")


@query(f"""WITH {_MATCH}, {_FPD}, {_FND}, {_IS}
SELECT 'fn_edge' AS what, source AS id, target AS other FROM (SELECT source, target FROM ge EXCEPT SELECT x_source, x_target FROM m) UNION ALL SELECT 'identity_switch', id, -1 FROM sw UNION ALL SELECT 'fp_division', id, -1 FROM fpd
UNION ALL SELECT CASE WHEN result = 'tp' THEN 'tp_division' ELSE result END, id, -1 FROM fnd""")
def failure_points(spark, sf_dir):
    """Every node and edge that is an error, and the divisions that are right."""
    return tracking.assess(*_both(spark, sf_dir), 0.5).points.fillna(-1, ["other"])


@query(None)
def evaluation(spark, sf_dir):
    """Every score of the reconstruction in one row."""
    return tracking.evaluate(*_both(spark, sf_dir), 0.5)


@query(None)
def iso_divisions(spark, sf_dir):
    """Missed and false divisions whose surroundings agree once chains are contracted."""
    g, r, m, _ = _matched(spark, sf_dir)
    return iso.iso_divisions(g, r, cut(m))


# ---- solving -------------------------------------------------------------


@query(None)
def greedy_tracks(spark, sf_dir):
    return greedy.greedy_track(tables.cells(spark, sf_dir), _candidates(spark, sf_dir), metric="distance", node_threshold=0.2)


TRACKING = objective.SolveParameters(track_cost=1.0, weight_edge_score=0.2, weight_node_score=-0.5, selection_constant=-0.8)


@query(None)
def ilp_tracks(spark, sf_dir):
    """The optimal forest of the whole candidate graph."""
    return rounded(solve.solve(tables.cells(spark, sf_dir), _candidates(spark, sf_dir), {1: TRACKING}).drop("component"), "cost")


_FAMILIES = "".join(f" UNION ALL SELECT '{name}', count(*), 0 FROM {of}" for name, of in (
    ("one_predecessor", "cells"), ("two_successors", "cells"), ("split_upper", "cells"), ("split_lower", "cells")))


@query(f"{'WITH ' + _PLAIN} SELECT 'edge_endpoints' AS family, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_broken FROM near{_FAMILIES} UNION ALL SELECT 'gap', 0, 0")
def ilp_basic(spark, sf_dir):
    """The optimal forest at the weights of the basic problem: rows of each family of constraints, how many the chosen edges break, and how many components have a gap."""
    cells, edges = tables.cells(spark, sf_dir), _candidates(spark, sf_dir)
    found = cut(solve.solve(cells, edges, {1: BASIC}, roi=None))
    return solve.checked(cells, edges, found).unionByName(found.agg(F.lit("gap").alias("family"), F.lit(0).cast("bigint").alias("n_rows"), F.count_distinct(F.when(F.col("gap") > 0, F.col("component"))).alias("n_broken")))


# ---- parameters and results ----------------------------------------------


@query("SELECT CAST(t.t AS DOUBLE) AS track_cost, e.event_type AS feature_func, CAST(z.z AS DOUBLE) AS max_cell_move FROM (SELECT DISTINCT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t FROM events) t, (SELECT DISTINCT event_type FROM events) e, (SELECT DISTINCT CAST(props->>'$.k' AS BIGINT) % 10 AS z FROM events) z")
def parameter_grid(spark, sf_dir):
    cells = tables.cells(spark, sf_dir)
    kinds = tables.read(spark, sf_dir, "events").select("event_type").distinct()
    return search.grid({"track_cost": cells.select(F.col("t").cast("double")).distinct(), "feature_func": kinds, "max_cell_move": cells.select(F.col("z") % 10).distinct()})


@query("SELECT track_cost, coalesce(context, -1) AS context, coalesce((SELECT max(param_id) FROM (SELECT p_partkey AS param_id, p_partkey / 3.0::DOUBLE AS c, nullif(p_size % 5, 0) AS k FROM part) s WHERE round(s.c, 10) = round(w.track_cost, 10) AND s.k IS NOT DISTINCT FROM w.context), -1) AS param_id FROM (SELECT p_partkey / 3.0::DOUBLE AS track_cost, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE nullif(p_size % 5, 0) END AS context FROM part) w")
def parameter_lookup(spark, sf_dir):
    part = tables.read(spark, sf_dir, "part")
    k = F.nullif(F.col("p_size") % 5, F.lit(0))
    stored = part.select(F.col("p_partkey").alias("param_id"), (F.col("p_partkey") / 3.0).alias("track_cost"), k.alias("context"))
    wanted = part.select((F.col("p_partkey") / 3.0).alias("track_cost"), F.when(F.col("p_partkey") % 4 != 0, k).alias("context"))
    return results.find_parameters(stored, wanted, ["track_cost", "context"], decimals=10).fillna(-1, ["context", "param_id"])


@query("""WITH s AS (SELECT o_orderkey AS param_id, CASE WHEN o_custkey % 10 <> 0 THEN o_orderpriority END AS tag, o_totalprice AS score FROM orders), n AS (SELECT CASE WHEN param_id % 2 = 0 THEN param_id ELSE param_id + 1000000000 END AS param_id, tag, score + 1 AS score FROM s WHERE param_id % 3 = 0)
SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.param_id = s.param_id AND n.tag IS NOT DISTINCT FROM s.tag) UNION ALL SELECT * FROM n""")
def score_upsert(spark, sf_dir):
    stored = tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("param_id"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_orderpriority")).alias("tag"), F.col("o_totalprice").alias("score"))
    new = stored.filter("param_id % 3 = 0").select(F.when(F.col("param_id") % 2 == 0, F.col("param_id")).otherwise(F.col("param_id") + 1000000000).alias("param_id"), "tag", (F.col("score") + 1).alias("score"))
    return results.upsert(stored, new, ["param_id", "tag"])


@query("SELECT CAST(row_number() OVER (ORDER BY track_cost, name) + (SELECT max(p_partkey) FROM part) AS BIGINT) AS param_id, track_cost, name FROM (SELECT c_acctbal AS track_cost, c_name AS name FROM customer)")
def parameter_ids(spark, sf_dir):
    stored = tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("param_id"))
    new = tables.read(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("track_cost"), F.col("c_name").alias("name"))
    return results.with_next_ids(stored, new, ["track_cost", "name"])


_SCORES = """SELECT l_suppkey AS param_id, CAST(sum(l_linenumber) AS BIGINT) AS fn_edges, count(*) FILTER (l_returnflag = 'R') AS identity_switches, count(*) FILTER (l_linestatus = 'O') AS fp_divisions, count(*) FILTER (l_returnflag = 'A') AS fn_divisions FROM lineitem GROUP BY l_suppkey"""


def _scores(spark, sf_dir, *by) -> DataFrame:
    return tables.read(spark, sf_dir, "lineitem").groupBy(*by).agg(
        F.sum("l_linenumber").alias("fn_edges"), F.count_if(F.col("l_returnflag") == "R").alias("identity_switches"), F.count_if(F.col("l_linestatus") == "O").alias("fp_divisions"), F.count_if(F.col("l_returnflag") == "A").alias("fn_divisions")
    )


_WEIGHTS = {"fn_edges": 1.0, "identity_switches": 0.5, "fp_divisions": 2.0, "fn_divisions": 1.5}


@query(f"SELECT *, CAST(trunc(fn_edges + 0.5 * identity_switches + 2 * fp_divisions + 1.5 * fn_divisions) AS BIGINT) AS sum_errors, CAST(fp_divisions + fn_divisions AS BIGINT) AS sum_divs FROM ({_SCORES})")
def results_sorted(spark, sf_dir):
    return results.sorted_results(_scores(spark, sf_dir, F.col("l_suppkey").alias("param_id")), _WEIGHTS, ("fp_divisions", "fn_divisions"))


@query("""WITH s AS (SELECT l_partkey % 50 AS param_id, nullif(l_partkey % 4, 0) AS context, l_returnflag AS sample, sum(l_linenumber) AS fn_edges, count(*) FILTER (l_linestatus = 'O') AS fp_divisions FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT param_id, context, CAST(sum(fn_edges) AS BIGINT) AS fn_edges, CAST(sum(fp_divisions) AS BIGINT) AS fp_divisions FROM s GROUP BY 1, 2 HAVING count(DISTINCT sample) = 3)
SELECT param_id, coalesce(context, -1) AS context, fn_edges, fp_divisions, CAST(fn_edges + 2 * fp_divisions AS BIGINT) AS sum_errors, CAST(fn_edges + fp_divisions AS BIGINT) AS sum_divs FROM g ORDER BY sum_errors, param_id LIMIT 1""")
def best_config(spark, sf_dir):
    by = (F.col("l_partkey") % 50).alias("param_id"), F.nullif(F.col("l_partkey") % 4, F.lit(0)).alias("context"), F.col("l_returnflag").alias("sample")
    summed = results.over_samples(_scores(spark, sf_dir, *by).select("param_id", "context", "sample", "fn_edges", "fp_divisions"), ["param_id", "context"], 3)
    return results.best(results.sorted_results(summed, {"fn_edges": 1.0, "fp_divisions": 2.0}, ("fn_edges", "fp_divisions"))).fillna(-1, ["context"])


# ---- arrays --------------------------------------------------------------

_VOXELS = _CELLS + ", vox AS (SELECT t, CAST(floor(z/10) AS BIGINT) AS z, CAST(floor(y/10) AS BIGINT) AS y, CAST(floor(x/20) AS BIGINT) AS x, max(score) AS value, avg(mv_z) AS mv_z, avg(mv_y) AS mv_y, avg(mv_x) AS mv_x FROM cells GROUP BY 1, 2, 3, 4)"
_POOL = _VOXELS + """, pool AS (SELECT v.t, v.z, v.y, v.x, v.value, max(u.value) AS pooled FROM vox v JOIN vox u ON u.t = v.t AND u.z BETWEEN v.z-1 AND v.z+1 AND u.y BETWEEN v.y-1 AND v.y+1 AND u.x BETWEEN v.x-1 AND v.x+1 GROUP BY 1, 2, 3, 4, 5)"""


def _voxels(spark, sf_dir) -> DataFrame:
    place = [F.floor(F.col(d) / s).cast("bigint").alias(d) for d, s in (("z", 10), ("y", 10), ("x", 20))]
    return tables.cells(spark, sf_dir).groupBy("t", *place).agg(F.max("score").alias("value"), *[F.avg("mv_" + d).alias("mv_" + d) for d in ("z", "y", "x")])


@query(f"WITH {_POOL} SELECT t, z, y, x, value, pooled, value = pooled AS maximum FROM pool")
def nms_maxima(spark, sf_dir):
    return arrays.local_maxima(_voxels(spark, sf_dir), (3, 3, 3)).select("t", "z", "y", "x", "value", "pooled", "maximum")


def _cantor(*c):
    out = f"CAST({c[0]} AS HUGEINT)"
    for d in c[1:]:
        out = f"(({out} + {d}) * ({out} + {d} + 1) // 2 + {d})"
    return f"CAST({out} AS BIGINT)"


@query(f"WITH {_POOL} SELECT {_cantor('t', 'z', 'y', 'x')} AS id, t, z * 5.0::DOUBLE + 1.0::DOUBLE AS z, y * 1.0::DOUBLE + 2.0::DOUBLE AS y, x * 1.0::DOUBLE + 3.0::DOUBLE AS x, value AS score FROM pool WHERE value = pooled AND value > 0.5 AND z < 9 AND z BETWEEN 1 AND 8")
def maxima_cells(spark, sf_dir):
    return arrays.maxima_to_cells(arrays.local_maxima(_voxels(spark, sf_dir), (3, 3, 3)), 0.5, begin=(1, 2, 3), voxel_size=(5, 1, 1), shape=(9, 1 << 40, 1 << 40), z_range=(1, 8))


@query(f"WITH {_POOL} SELECT {_cantor('c.t', 'c.z', 'c.y', 'c.x')} AS id, round(avg(v.mv_z + v.z - c.z), 6) AS mv_z, round(avg(v.mv_y + v.y - c.y), 6) AS mv_y, round(avg(v.mv_x + v.x - c.x), 6) AS mv_x FROM pool c JOIN vox v ON v.t = c.t AND abs(v.z-c.z) <= 1 AND abs(v.y-c.y) <= 1 AND abs(v.x-c.x) <= 1 WHERE c.value = c.pooled GROUP BY 1")
def avg_movement_vector(spark, sf_dir):
    v = _voxels(spark, sf_dir)
    centres = arrays.local_maxima(v, (3, 3, 3)).filter("maximum").select(arrays.cantor("t", "z", "y", "x").alias("id"), "t", "z", "y", "x")
    return rounded(arrays.average_motion(v, centres, 3), "mv_z", "mv_y", "mv_x")


_STATS = _CELLS + ", s AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS mean, stddev_pop(x) AS sd, median(x) AS med, quantile_cont(x, 0.01) AS p1, quantile_cont(x, 0.99) AS p99 FROM cells)"


def _normal(kind: str, sql: str):
    def f(spark, sf_dir):
        return rounded(arrays.normalize(tables.cells(spark, sf_dir).select("id", F.col("x").alias("value")), kind), "normalized")

    f.__name__ = f"normalize_{kind}"
    return query(f"WITH {_STATS} SELECT id, x AS value, round({sql}, 6) AS normalized FROM cells, s")(f)


_normal("minmax", "(least(greatest(x, lo / 2), hi * 2) - lo) / (hi - lo)")
_normal("percminmax", "(x - p1) / (p99 - p1)")
_normal("mean", "(x - mean) / sd")
_normal("median", "(least(greatest(x, p1), p99) - med) / sd")


@query(f"WITH {_CELLS} SELECT id, round(score * 1.2::DOUBLE + score * (1 - score) * (1 - 1.2::DOUBLE), 6) AS histogram, least(greatest(score, 0.2::DOUBLE), 0.8::DOUBLE) AS clipped, round(CAST(CAST((score - 0.5) / 0.25 AS FLOAT) AS DOUBLE), 5) AS around_zero, round((score - 0.1) / (0.9 - 0.1), 6) AS lower_upper, CASE WHEN id % 10 = 1 THEN 'val' ELSE 'train' END AS provider, round(1.0 / (1.0 + exp(0.01::DOUBLE * (100.0::DOUBLE - t))), 6) AS blend FROM cells")
def intensities(spark, sf_dir):
    s = F.col("score")
    return tables.cells(spark, sf_dir).select(
        "id", F.round(arrays.histogram_augment(s, 1.2), 6).alias("histogram"), arrays.clip(s, 0.2, 0.8).alias("clipped"), F.round(arrays.normalize_around_zero(s, 0.5, 0.25).cast("double"), 5).alias("around_zero"),
        F.round(arrays.normalize_lower_upper(s, 0.1, 0.9), 6).alias("lower_upper"), arrays.provider(F.col("id"), 10).alias("provider"), F.round(arrays.loss_blend(F.col("t"), 0.01, 100.0), 6).alias("blend"),
    )


@query(None)
def noise_augment(spark, sf_dir):
    s = F.col("score")
    return tables.cells(spark, sf_dir).select("id", *[arrays.noise(s, k, 0.01, 7).alias(k) for k in ("gaussian", "speckle", "salt_pepper")])


@query(f"WITH {_CELLS} SELECT id, t, 50.0 + (z - 50.0) * 1.25::DOUBLE AS z, 75.0 + (y - 75.0) * 1.25::DOUBLE AS y, 250.0 + (x - 250.0) * 1.25::DOUBLE AS x FROM cells")
def zoom_points(spark, sf_dir):
    return arrays.zoom_points(tables.cells(spark, sf_dir), (50.0, 75.0, 250.0), 1.25)


@query(f"WITH {_CELLS} SELECT id, t, round((z - 50.0) * 1.5::DOUBLE + 50.0, 6) AS z, round(((y - 75.0) * 0.8::DOUBLE - (x - 250.0) * 0.6::DOUBLE) * 1.0::DOUBLE + 75.0, 6) AS y, round(((y - 75.0) * 0.6::DOUBLE + (x - 250.0) * 0.8::DOUBLE) * 0.5::DOUBLE + 250.0, 6) AS x FROM cells")
def affine_points(spark, sf_dir):
    return rounded(arrays.rotate_scale_points(tables.cells(spark, sf_dir), (50.0, 75.0, 250.0), 0.8, 0.6, (1.5, 1.0, 0.5)), "z", "y", "x")


@query(f"WITH {_CELLS}, s AS (SELECT id, t, z + CASE WHEN t = 3 THEN 2.0::DOUBLE ELSE 0.0 END AS z, y + CASE WHEN t = 3 THEN -1.0::DOUBLE WHEN t = 4 THEN 4.0::DOUBLE ELSE 0.0 END AS y, x + CASE WHEN t = 3 THEN 5.0::DOUBLE WHEN t = 4 THEN -6.0::DOUBLE ELSE 0.0 END AS x FROM cells) SELECT * FROM s WHERE t >= 0 AND t < 7 AND z >= 10 AND z < 80 AND y >= 20 AND y < 100 AND x >= 50 AND x < 300")
def shift_points(spark, sf_dir):
    return arrays.shift_points(tables.cells(spark, sf_dir).select("id", "t", "z", "y", "x"), {3: (2, -1, 5), 4: (0, 4, -6)}, Roi((0, 10.0, 20.0, 50.0), (7, 70.0, 80.0, 250.0)))


@query(f"WITH {_CELLS} SELECT DISTINCT t, CAST(floor(z / 5.0) AS BIGINT) AS z, CAST(floor(y) AS BIGINT) AS y, CAST(floor(x) AS BIGINT) AS x FROM cells")
def rasterize_point(spark, sf_dir):
    return arrays.rasterize_points(tables.cells(spark, sf_dir), (5.0, 1.0, 1.0))


#: Lines of the annotation's edges in voxels of 5 x 1 x 20, coloured by track: the least id of its cells.
_LINES = f"""WITH RECURSIVE {_TRACKS}, w AS (SELECT id, id AS root FROM gn WHERE id NOT IN (SELECT source FROM ge) UNION ALL SELECT ge.source, w.root FROM w JOIN ge ON ge.target = w.id),
lab AS (SELECT id, min(id) OVER (PARTITION BY root) AS label FROM w), v AS (SELECT id, CAST(t AS BIGINT) AS t, CAST(floor(z / 5.0) AS BIGINT) AS z, CAST(floor(y / 1.0) AS BIGINT) AS y, CAST(floor(x / 20.0) AS BIGINT) AS x, label FROM gn JOIN lab USING (id)),
e AS (SELECT source, target, s.label, o.t, o.z, o.y, o.x, s.t - o.t AS dt, s.z - o.z AS dz, s.y - o.y AS dy, s.x - o.x AS dx, greatest(abs(s.t - o.t), abs(s.z - o.z), abs(s.y - o.y), abs(s.x - o.x)) AS n FROM ge JOIN v s ON s.id = source JOIN v o ON o.id = target),
l AS (SELECT source, target, label, {', '.join(f'CAST(round_even({a} + k * (d{a} / CAST(n AS DOUBLE)), 0) AS BIGINT) AS {a}' for a in 'tzyx')} FROM (SELECT *, unnest(range(n + 1)) AS k FROM e)),
spot AS (SELECT t, z, y, x, label, 0 AS r, id AS a, id AS b FROM v UNION ALL SELECT t, z, y, x, label, 1, source, target FROM l),
painted AS (SELECT t, z, y, x, label FROM (SELECT *, row_number() OVER (PARTITION BY t, z, y, x ORDER BY r DESC, a DESC, b DESC) AS k FROM spot) WHERE k = 1)"""


def _coloured(spark, sf_dir):
    g = tables.gt(spark, sf_dir, often=True)
    colours = cut(graph.tracks(g.nodes, g.edges).withColumnRenamed("track", "label"))
    return g.nodes.join(colours, "id"), g.edges.join(colours.withColumnRenamed("id", "source"), "source")


@query(f"{_LINES} SELECT t, z, y, x, label FROM painted")
def rasterize_lines(spark, sf_dir):
    return arrays.rasterize_graph(*_coloured(spark, sf_dir), (5.0, 1.0, 20.0))


@query(f"""{_LINES}, near AS (SELECT t, z + a.a AS z, y + b.b AS y, x, a.a * 5 * a.a * 5 + b.b * b.b AS d2, label FROM painted, range(-1, 2) a(a), range(-5, 6) b(b) WHERE a.a * 5 * a.a * 5 + b.b * b.b <= 25),
grown AS (SELECT t, z, y, x, d2, label FROM (SELECT *, row_number() OVER (PARTITION BY t, z, y, x ORDER BY d2, label) AS k FROM near) WHERE k = 1) SELECT t, z, y, x, label FROM grown WHERE d2 > 6.25""")
def rasterize_tubes(spark, sf_dir):
    """Hollow tubes around the lines."""
    return arrays.rasterize_graph(*_coloured(spark, sf_dir), (5.0, 1.0, 20.0), radius=5.0, hollow=0.5)


def _spots(n: str, r: int) -> str:
    reach = f"range({-r - 1}, {r + 2})"
    return f"""spots AS (SELECT * FROM (SELECT {n}.*, CAST(floor({n}.z) AS BIGINT) + a.a AS vz, CAST(floor({n}.y) AS BIGINT) + b.b AS vy, CAST(floor({n}.x) AS BIGINT) + c.c AS vx FROM {n}, {reach} a(a), {reach} b(b), {reach} c(c))
  WHERE (vz-z)*(vz-z)+(vy-y)*(vy-y)+(vx-x)*(vx-x) <= {r * r})"""


@query(f"WITH {_TRACKS}, mn AS (SELECT n.*, p.z AS pz, p.y AS py, p.x AS px FROM gn n JOIN ge ON source = n.id JOIN gn p ON p.id = target), {_spots('mn', 2)} SELECT t, vz AS z, vy AS y, vx AS x, round(arg_max(pz - vz, id), 6) AS mv_z, round(arg_max(py - vy, id), 6) AS mv_y, round(arg_max(px - vx, id), 6) AS mv_x FROM spots GROUP BY 1, 2, 3, 4")
def movement_vector_paint(spark, sf_dir):
    g = tables.gt(spark, sf_dir, often=True)
    return rounded(arrays.paint_motion(g.nodes, g.edges, 2.0), "mv_z", "mv_y", "mv_x")


@query(f"WITH {_TRACKS}, {_spots('gn', 2)} SELECT DISTINCT t, vz AS z, vy AS y, vx AS x FROM spots")
def rasterize_ball(spark, sf_dir):
    return arrays.rasterize_balls(tables.gt(spark, sf_dir).nodes, 2.0)


@query(f"WITH {_TRACKS}, {_spots('gn', 2)}, v AS (SELECT t, vz AS z, vy AS y, vx AS x, sum(exp(-((vz-spots.z)*(vz-spots.z)+(vy-spots.y)*(vy-spots.y)+(vx-spots.x)*(vx-spots.x)) / 2.0::DOUBLE)) AS value FROM spots GROUP BY 1, 2, 3, 4) SELECT t, z, y, x, round(value / max(value) OVER (PARTITION BY t), 6) AS value FROM v")
def rasterize_peak(spark, sf_dir):
    return rounded(arrays.rasterize_peaks(tables.gt(spark, sf_dir).nodes, 1.0, 2), "value")


_P = _CELLS + ", r AS (SELECT *, mv_z + (score - 0.5) * 4 AS p_z, mv_y + (score - 0.5) * 2 AS p_y, mv_x + (score - 0.5) AS p_x, id % 2 AS truth, 1.0 + id % 3 AS weight FROM cells), q AS (SELECT *, sqrt(p_z*p_z+p_y*p_y+p_x*p_x) AS np, sqrt(mv_z*mv_z+mv_y*mv_y+mv_x*mv_x) AS nm, sqrt((p_z-mv_z)*(p_z-mv_z)+(p_y-mv_y)*(p_y-mv_y)+(p_x-mv_x)*(p_x-mv_x)) AS err FROM r)"


@query(f"WITH {_P} SELECT round(avg(CASE WHEN score > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS indicator_rate, round(avg(CASE WHEN np <> 0 AND nm <> 0 AND (p_z*mv_z+p_y*mv_y+p_x*mv_x) / (np * nm) > 0.9 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS cosine_rate, round(avg(err), 6) AS mean_error, round(avg(CASE WHEN err < 1 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS close_rate, round(sum(CAST(weight AS DOUBLE) * (score - truth) * (score - truth)) / sum(CAST(weight AS DOUBLE)), 6) AS weighted_mse FROM q")
def training_metrics(spark, sf_dir):
    s = F.col("score") - 0.5
    rows = tables.cells(spark, sf_dir).withColumns({"p_z": F.col("mv_z") + s * 4, "p_y": F.col("mv_y") + s * 2, "p_x": F.col("mv_x") + s, "truth": F.col("id") % 2, "weight": 1.0 + F.col("id") % 3, "indicator": F.col("score")})
    return rounded(arrays.training_metrics(rows), "indicator_rate", "cosine_rate", "mean_error", "close_rate", "weighted_mse")


@query("WITH b AS (SELECT DISTINCT user_id * 100 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 5 AS block_id, user_id % 2 = 0 AS old FROM events) SELECT block_id FROM b WHERE NOT old")
def done_ledger(spark, sf_dir):
    e = tables.cells(spark, sf_dir).select((F.col("y") * 100).cast("bigint").alias("u"), ledger.block_of(F.col("t"), 5).alias("b"))
    blocks = e.select((F.col("u") + F.col("b")).alias("block_id")).distinct()
    step = ledger.step_name("solve", [1, 2])
    old = blocks.filter(F.floor(F.col("block_id") / 100) % 2 == 0)
    empty = blocks.select(F.lit("other").alias("step"), "block_id")
    return ledger.unfinished(blocks, ledger.finish(empty, old, step), step)
