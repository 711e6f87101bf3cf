import random

import pytest
from helpers import DIVISION, graph, pairs
from pyspark.sql import functions as F

from spoor.functions.numbering import dense_numbers
from spoor.functions.roi import Roi, frame_value
from spoor.operators import arrays, filters, graph as graphs, results, search, spatial
from spoor.operators.divisions import division_reports
from spoor.plans.components import connected_components
from spoor.plans.tracking import extract_edges, solve_store
from spoor.operators.objective import SolveParameters
from spoor.sources import tracks_file
from spoor.sources.store import GraphStore, find, find_or_create
from spoor.streaming import ledger

ROWS = ["0 0 0 0 1 -1 0", "1 0 0 0 2 1 0", "1 1 2 3 3 1 0", "2 2 2 2 4 3 0", "1 1 1 1 5 -1 0"]


def points(spark, rows):
    return spark.createDataFrame([(f, float(z), float(y), float(x), i) for f, z, y, x, i in rows], "t int, z double, y double, x double, id bigint")


def test_division_reports(spark):
    gt = points(spark, [(2, 0, 0, 0, 1), (3, 5, 5, 5, 2), (3, 10, 10, 10, 3), (4, 1, 10, 100, 4)])
    rec = points(spark, [(3, 0, 0, 0, 10), (3, 5, 5, 5, 20), (3, 50, 50, 50, 50), (4, 10, 10, 10, 30)])
    rows = [tuple(r) for r in division_reports(gt, rec, 3, 1.5, 1).orderBy("leniency").collect()]
    assert rows[0][:7] == pytest.approx((0, 2, 3, 2, 1, 1 / 3, 1 / 2))
    assert rows[1][:7] == pytest.approx((1, 2, 3, 1, 0, 2 / 3, 1))


def test_tracks_file(spark, tmp_path):
    path = tmp_path / "tracks.txt"
    path.write_text("\n".join(["t z y x cell_id parent_id track_id", *ROWS, "1 1 1 9 5 -1 0"]))
    rows = tracks_file.read_tracks(spark, str(path), with_state=True)
    assert {(r["cell_id"], r["div_state"]) for r in rows.collect()} == {(1, 1), (2, 2), (3, 2), (4, 0), (5, 0)}
    assert rows.filter("cell_id = 5").first()["x"] == 9.0  # the last row of an id counts
    g = tracks_file.to_graph(rows, Roi((1, 0, 0, 0), (2, 9, 9, 99)))
    assert pairs(g.edges) == {(4, 3)}
    other = tmp_path / "headless.txt"
    other.write_text("\n".join(ROWS))
    with pytest.raises(ValueError):
        tracks_file.read_tracks(spark, str(other))


def test_painted_vectors(spark):
    g = graph(spark, [(1, 0, 0, 0, 0), (3, 1, 1, 2, 3)], [(3, 1)])
    painted = {tuple(r) for r in arrays.paint_motion(g.nodes, g.edges, 0.1).collect()}
    assert painted == {(1, 1, 2, 3, -1.0, -2.0, -3.0)}


@pytest.mark.parametrize("edge", [1, 3, 5])
def test_average_motion(spark, edge):
    rows = [(0, z, y, x, *[float(27 * k + 9 * z + 3 * y + x) for k in range(3)]) for z in range(3) for y in range(3) for x in range(3)]
    motion = spark.createDataFrame(rows, "t int, z bigint, y bigint, x bigint, mv_z double, mv_y double, mv_x double")
    centre = spark.createDataFrame([(1, 0, 1, 1, 1)], "id bigint, t int, z bigint, y bigint, x bigint")
    assert tuple(arrays.average_motion(motion, centre, edge).first()) == (1, 13.0, 40.0, 67.0)


def test_local_maxima_need_no_dense_array(spark):
    v = spark.createDataFrame([(0, 0, 0, 0, 1.0), (0, 1, 1, 1, 2.0), (0, 5, 5, 5, 0.5)], "t int, z bigint, y bigint, x bigint, value double")
    found = {(r["z"], r["maximum"]) for r in arrays.local_maxima(v, (3, 3, 3)).collect()}
    assert found == {(0, False), (1, True), (5, True)}


def test_range_join_by_force(spark):
    rng = random.Random(4)
    cells = [(i, rng.randrange(4), *[rng.uniform(-20, 20) for _ in range(3)]) for i in range(120)]
    g = graph(spark, cells, [])
    nodes = g.nodes.selectExpr("*", "1.0D as mv_z", "-2.0D as mv_y", "0.5D as mv_x")
    move = (1.0, -2.0, 0.5)
    got = {(r["source"], r["target"]) for r in spatial.candidate_edges(nodes, {2: 6.0, -1: 9.0}).collect()}
    near = lambda a, b, r: sum((p + m - q) ** 2 for p, m, q in zip(a[2:], move, b[2:])) <= r * r
    assert got == {(a[0], b[0]) for a in cells for b in cells if b[1] == a[1] - 1 and near(a, b, 6.0 if a[1] < 2 else 9.0)}


def test_frame_value_without_default_is_an_error(spark):
    with pytest.raises(Exception, match="no value"):
        spark.range(9, 10).select(frame_value(spark.range(1)["id"] * 0 + 9, {5: 1.0})).collect()


def test_components_by_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200, i) for i in range(300, 340)] + [(i, i + 1) for i in range(500, 530)]
    least = {}

    def root(x):
        least.setdefault(x, x)
        while least[x] != x:
            x = least[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            least[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in list(least)}


def test_segments(spark):
    g = graph(spark, *DIVISION)
    sizes = sorted(r["count"] for r in graphs.segments(g.edges).groupBy("segment").count().collect())
    assert sizes == [1, 2, 3]


def test_numbers_are_dense(spark):
    rows = dense_numbers(spark.range(50).selectExpr("49 - id as v"), ["v"], "n").collect()
    assert sorted((r["v"], r["n"]) for r in rows) == [(i, i) for i in range(50)]


def test_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "db"), "w")
    cells = spark.createDataFrame([(i, t, 1.0, 1.0, float(x), 2.0, 0.0, 0.0, 0.0) for i, t, x in ((0, 0, 1), (1, 1, 1), (2, 2, 0), (3, 2, 2), (4, 2, 3), (5, 3, 2))], "id bigint, t int, z double, y double, x double, score double, mv_z double, mv_y double, mv_x double")
    store.write("nodes", cells, by=["t"])
    extract_edges(store, 2.0)
    assert pairs(store.read("edges").select("source", "target")) == {(1, 0), (2, 1), (3, 1), (4, 1), (5, 3), (5, 2), (5, 4)}
    p = SolveParameters(track_cost=4.0, weight_edge_score=0.1, weight_node_score=-0.1, selection_constant=-1.0)
    solve_store(store, {1: p})
    nodes, edges = store.selected(1)
    assert edges.count() == 4 and nodes.count() == 5
    store.reset_selection([1], Roi((3, 0, 0, 0), (1, 9, 9, 9)))
    assert store.selected(1)[1].count() == 3
    store.reset_selection()
    assert store.selected(1)[1].count() == 0
    wanted = spark.createDataFrame([(1.5, "a"), (2.5, None)], "track_cost double, tag string")
    ids = {r["track_cost"]: r["param_id"] for r in store.parameter_ids(wanted, ["track_cost", "tag"]).collect()}
    assert ids == {1.5: 1, 2.5: 2} == {r["track_cost"]: r["param_id"] for r in store.parameter_ids(wanted, ["track_cost", "tag"]).collect()}
    assert [r["track_cost"] for r in store.parameters([2, 7, 1]).collect()] == [2.5, None, 1.5]
    for value in (3.0, 4.0):
        store.write_score(spark.createDataFrame([(1, None, value)], "param_id int, tag string, score double"), ["param_id", "tag"])
    assert [r["score"] for r in store.scores().collect()] == [4.0]


def test_registry(spark):
    rows = spark.createDataFrame([("a", "s1", None), ("b", "s1", "r"), ("c", "s2", None)], "name string, sample string, roi string")
    assert find(rows, {"sample": "s1", "roi": None}) == "a" and find(rows, {"sample": "s3"}) is None
    with pytest.raises(ValueError):
        find(rows, {"sample": "s1", "roi": None}, with_roi=False)


def test_datasets_are_created_once(spark, tmp_path):
    registry = GraphStore(spark, str(tmp_path / "registry"), "a")
    one = find_or_create(registry, {"sample": "a/b", "checkpoint": 10, "roi": None})
    assert one == "a_b_10" == find_or_create(registry, {"sample": "a/b", "checkpoint": 10, "roi": None})
    two = find_or_create(registry, {"sample": "a_b", "checkpoint": 10, "roi": None})
    assert two == "a_b_10_2" and registry.read("meta").count() == 2


def test_steps_can_be_repeated(spark, tmp_path):
    from spoor.plans.tracking import evaluate_store
    from spoor.sources.tables import Graph

    store = GraphStore(spark, str(tmp_path / "db"), "w")
    cells = spark.createDataFrame([(i, t, 1.0, 1.0, float(x), 2.0, 0.0, 0.0, 0.0) for i, t, x in ((0, 0, 1), (1, 1, 1), (2, 2, 0), (3, 2, 2), (4, 2, 3), (5, 3, 2))], "id bigint, t int, z double, y double, x double, score double, mv_z double, mv_y double, mv_x double")
    store.write("nodes", cells, by=["t"])
    store.write("nodes", cells, by=["t"])
    assert store.read("nodes").count() == 6
    left, right = Roi((0, 0, 0, 0), (9, 9, 9, 2)), Roi((0, 0, 0, 2), (9, 9, 9, 9))
    for roi in (left, right, left):
        extract_edges(store, 2.0, roi=roi)
    extract_edges(store, 2.0)
    extract_edges(store, 2.0)
    edges = store.read("edges").select("source", "target")
    assert edges.count() == edges.distinct().count() == 7
    p = SolveParameters(track_cost=4.0, weight_edge_score=0.1, weight_node_score=-0.1, selection_constant=-1.0)
    for _ in range(2):
        solve_store(store, {1: p})
    solve_store(store, {1: p}, from_scratch=True)
    assert store.read("selections").count() == 7
    assert {r["step"].split("_")[0] for r in store.read("done").collect()} == {"extract", "solve"}
    gt = Graph(cells.select("id", "t", "z", "y", "x"), spark.createDataFrame([(1, 0), (2, 1), (3, 1), (5, 3)], "source bigint, target bigint"))
    settings = dict(threshold=0.5, window=3)
    first = evaluate_store(store, gt, 1, settings).first()
    assert first["matched_edges"] == 4 and evaluate_store(store, None, 1, settings).first() == first  # the second comes from the store
    assert store.read("scores").count() == 1


def test_a_broken_replacement_leaves_the_old_table(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "db"), "w")
    store.write("selections", spark.range(3))
    (tmp_path / "db" / "selections" / "v2").mkdir()  # written in part: no mark of success
    assert store.read("selections").count() == 3
    store.replace("selections", spark.range(5))
    assert store.read("selections").count() == 5 and not (tmp_path / "db" / "selections" / "v1").exists()


def test_command_line(spark, tmp_path, capsys):
    from spoor.plans import cli

    store = GraphStore(spark, str(tmp_path / "db"), "w")
    rows = [(i, t, 1.0, 1.0, float(x), 2.0, 0.0, 0.0, 0.0) for i, t, x in ((0, 0, 1), (1, 1, 1), (2, 2, 1))]
    store.write("nodes", spark.createDataFrame(rows, "id bigint, t int, z double, y double, x double, score double, mv_z double, mv_y double, mv_x double"), by=["t"])
    (tmp_path / "tracks.txt").write_text("t\tz\ty\tx\tcell_id\tparent_id\ttrack_id\n0\t1\t1\t1\t7\t-1\t7\n1\t1\t1\t1\t8\t7\t7\n2\t1\t1\t1\t9\t8\t7\n")
    (tmp_path / "c.toml").write_text(f'store = "{tmp_path}/db"\n[extract]\nedge_move_threshold = 2\n[solve]\nparameters = [{{track_cost = 4.0, weight_edge_score = 0.1, weight_node_score = -0.1, selection_constant = -1.0}}]\n[evaluate]\nmatching_threshold = 0.5\n')
    for _ in range(2):
        cli.main([str(tmp_path / "c.toml"), "extract", "solve", "evaluate", "best", "--annotation", str(tmp_path / "tracks.txt")])
    assert "sum_errors" in capsys.readouterr().out
    assert store.read("scores").count() == 1 and store.read("scores").first()["f_score"] == 1.0


def test_results(spark):
    scores = spark.createDataFrame([(1, "a", 1.0, 2), (1, "b", 2.5, 3), (2, "a", 9.0, 9), (None, "a", 1.0, 0), (None, "b", 1.0, 0)], "param_id int, sample string, fn_edges double, fp_divisions int")
    summed = results.over_samples(scores, ["param_id"], 2)
    ranked = results.sorted_results(summed, {"fn_edges": 1.0}, ("fn_edges", "fp_divisions"))
    assert [(r["param_id"], r["sum_errors"], r["sum_divs"]) for r in ranked.collect()] == [(None, 2, 2), (1, 3, 8)]
    with pytest.raises(ValueError):
        results.sorted_results(summed.limit(0), {}, ("fn_edges", "fp_divisions"))


def test_random_configs():
    drawn = search.random_configs({"a": [1, 2, 3], "b": [0.0, 1.0], "c": "x", "d": [[0, 10], [1, 20]], "e": ["", ""]}, 20, 5)
    assert drawn == search.random_configs({"a": [1, 2, 3], "b": [0.0, 1.0], "c": "x", "d": [[0, 10], [1, 20]], "e": ["", ""]}, 20, 5)
    assert all(c["a"] in (1, 2, 3) and 0 <= c["b"] <= 1 and c["c"] == "x" and (0 <= c["d"] <= 1 or 10 <= c["d"] <= 20) and c["e"] is None for c in drawn)


def test_shift_table_keeps_the_centre():
    for seed in range(20):
        table = arrays.shift_table(random.Random(seed), 0.4, 0.4, 3.0)
        assert len(table) == 7 and table[3] == (0, 0, 0)


def test_crops():
    assert arrays.centre_crop((10, 9), (4, 3)) == [(3, 7), (3, 6)] and arrays.crop_to_factor(37, 8, 4) == 36


def test_ledger_and_states(spark):
    blocks = spark.range(4).withColumnRenamed("id", "block_id")
    done = spark.createDataFrame([], "step string, block_id bigint")
    done = ledger.finish(ledger.finish(done, blocks.filter("block_id < 2"), "s"), blocks.filter("block_id = 1"), "s")
    assert done.count() == 2 and {r["block_id"] for r in ledger.unfinished(blocks, done, "s").collect()} == {2, 3}
    assert not ledger.all_finished(blocks, done, "s") and ledger.step_name("a", [2, 1]) == ledger.step_name("a", [1, 2])


def test_frames_as_a_stream(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 01:00:00' + make_interval(0,0,0,id,0,0,0) as ts, double(id) as value from range(6)")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = ledger.frame_counts(stream).writeStream.format("memory").queryName("frames").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert spark.table("frames").count() == 6


def test_roi_values():
    a, b = Roi((0, 0, 0, 0), (5, 10, 10, 10)), Roi((2, 5, -5, 0), (9, 3, 9, None))
    assert a.intersect(b) == Roi((2, 5, 0, 0), (3, 3, 4, 10)) and a.union(b).offset == (0, 0, -5, 0)
    assert Roi((1,), (5,)).snap((4,)) == Roi((0,), (8,)) and Roi((1,), (5,)).grow((1,), (2,)) == Roi((0,), (8,))


def test_consecutive_states(spark):
    rows = spark.createDataFrame([(1, -1), (2, 1), (3, 1), (4, 1)], "cell_id bigint, parent_id bigint")
    with pytest.raises(Exception, match="two children"):
        filters.division_state(rows).collect()
    rows = spark.createDataFrame([(1, -1), (2, 1), (3, 1), (4, 2), (5, 2)], "cell_id bigint, parent_id bigint")
    with pytest.raises(Exception, match="successive divisions"):
        filters.division_state(rows).collect()
    states = lambda **how: {r["cell_id"]: r["div_state"] for r in filters.division_state(rows, **how).collect()}
    assert states(allow_consecutive=True) == {1: 1, 2: 1, 3: 2, 4: 2, 5: 2} and states(strict=True) == {1: 0, 2: 2, 3: 2, 4: 2, 5: 2}


def test_small_helpers(spark):
    configs = spark.range(20).withColumnRenamed("id", "a")
    some = [r["a"] for r in search.some(configs, 5, 3).collect()]
    assert some == [r["a"] for r in search.some(configs.repartition(3), 5, 3).collect()] and len(set(some)) == 5
    rows = spark.createDataFrame([(1, 0, "x", 1.0), (1, 2, "y", None), (2, 1, "x", 2.0)], "k bigint, t int, tag string, v double")
    assert {(r["k"], r["t"]) for r in filters.latest_rows(rows, "k", "t").collect()} == {(1, 2), (2, 1)}
    assert rows.filter(filters.is_frame(1)).count() == 1 and rows.filter(filters.matches_parameters({"tag": "y", "v": None})).count() == 1
    with pytest.raises(ValueError):
        from spoor.plans.config import verified

        verified({1: SolveParameters(check_node_close_to_roi=True)})


def test_radii_masks_and_report(spark, tmp_path):
    from spoor.operators import divisions

    nodes = spark.createDataFrame([(1, 0, 5.0, 5.0, 5.0, 1.2), (2, 0, 9.0, 9.0, 9.0, 3.1), (3, 1, 5.0, 5.0, 6.0, None)], "id bigint, t int, z double, y double, x double, radius double")
    assert {r["t"]: r["radius"] for r in arrays.average_radius(nodes, 7.0).collect()} == {0: 3.0, 1: 7.0}
    edges = spark.createDataFrame([(3, 1)], "source bigint, target bigint")
    mask, painted = arrays.motion_mask(nodes, edges, 1.0), arrays.paint_motion(nodes, edges, 1.0)
    assert mask.count() == painted.count() == 7
    labels = spark.createDataFrame([(0, 5, 5, x, 1 if x < 6 else 2) for x in range(4, 8)], "t int, z bigint, y bigint, x bigint, label int")
    assert {r["x"] for r in arrays.rasterize_balls(nodes.filter("id = 1"), 1.0, labels).collect()} == {4, 5}
    report = divisions.division_reports(nodes.filter("id < 3"), nodes.filter("id < 3"), 0, 0.5, 1)
    divisions.write_report(report, str(tmp_path / "report"))
    back = spark.read.option("header", True).csv(str(tmp_path / "report")).collect()
    assert [(r["leniency"], r["gt_total"], r["fp"]) for r in back] == [("0", "2", "0"), ("1", "2", "0")]


def test_percentiles_by_rank(spark):
    from spoor.functions.numbering import percentiles

    rng = random.Random(8)
    values = [rng.choice([None, rng.uniform(0, 9), 3.0]) for _ in range(200)]
    there = sorted(v for v in values if v is not None)
    got = percentiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [0.0, 0.01, 0.5, 0.99, 1.0])
    at = lambda p: there[int(p)] + (there[min(int(p) + 1, len(there) - 1)] - there[int(p)]) * (p - int(p))
    assert got == pytest.approx([at(s * (len(there) - 1)) for s in (0.0, 0.01, 0.5, 0.99, 1.0)])
    assert percentiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_components_in_one_task_and_in_rounds(spark):
    from spoor.plans.components import connected_components

    rng = random.Random(9)
    edges = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)], "a bigint, b bigint")
    as_set = lambda df: {(r["node"], r["component"]) for r in df.collect()}
    assert as_set(connected_components(edges)) == as_set(connected_components(edges, few=-1))


def test_config_and_text(spark, tmp_path):
    from spoor.operators.objective import as_text, constraints, objective
    from spoor.plans.config import Config, dump, latest, work_items

    (tmp_path / "solve.json").write_text('{"grid": {"track_cost": [1.0, 2.0], "weight_edge_score": [0.1, 0.2, 0.3]}}')
    (tmp_path / "c.toml").write_text('store = "/x"\nsolve = "solve.json"\n[roi]\noffset = [0, 0, 0, 0]\nshape = [5, 5, 5, 5]\n[extract]\nedge_move_threshold = 9\n')
    config = Config.from_file(str(tmp_path / "c.toml"))
    assert len(config.solve.sets()) == 6 and config.extract.edge_move_threshold == {-1: 9.0} and config.roi.roi.end == (5, 5, 5, 5) and '"store": "/x"' in dump(config)
    (tmp_path / "bad.toml").write_text('store = "/x"\nwrong = 1\n')
    with pytest.raises(ValueError):
        Config.from_file(str(tmp_path / "bad.toml"))
    assert latest(["a_9", "a_10", "a_1"]) == "a_10" and len(work_items(["s", "t"], [1, 2], [1, 2, 3])) == 12
    g = graph(spark, [(1, 0, 0, 0, 0), (2, 1, 0, 0, 0)], [(2, 1)])
    nodes, edges = g.nodes.selectExpr("*", "1.0D as score"), g.edges.selectExpr("*", "2.0D as prediction_distance")
    lines = [r["value"] for r in as_text(objective(nodes, edges, SolveParameters()), constraints(nodes, edges)).collect()]
    assert len(lines) == 7 + 1 + 2 * 4 and any(line.startswith("edge_endpoints") and line.endswith("<= 0.0") for line in lines)


def volume(spark, frames=2, size=5, value=lambda t, z, y, x: 0.0):
    return spark.createDataFrame([(t, z, y, x, float(value(t, z, y, x))) for t in range(frames) for z in range(size) for y in range(size) for x in range(size)], "t int, z bigint, y bigint, x bigint, value double")


def test_cells_from_voxels(spark, tmp_path):
    from spoor.plans.tracking import extract_cells

    peaks = {(0, 1, 1, 1): 0.9, (0, 3, 3, 3): 0.8, (1, 2, 2, 2): 0.7, (1, 0, 0, 4): 0.1}
    voxels = volume(spark, value=lambda *at: peaks.get(at, 0.0))
    motion = voxels.select("t", "z", "y", "x", F.lit(1.0).alias("mv_z"), F.col("y").cast("double").alias("mv_y"), F.lit(0.0).alias("mv_x"))
    store = GraphStore(spark, str(tmp_path / "db"), "w")
    for _ in range(2):
        extract_cells(store, voxels, (3, 3, 3), 0.5, motion, 3, begin=(10, 0, 0), voxel_size=(2, 1, 1))
    rows = {(r["t"], r["z"], r["y"], r["x"]): (r["score"], r["mv_z"], r["mv_y"]) for r in store.read("nodes").collect()}
    assert rows == {(0, 12.0, 1.0, 1.0): (0.9, 1.0, 1.0), (0, 16.0, 3.0, 3.0): (0.8, 1.0, 3.0), (1, 14.0, 2.0, 2.0): (0.7, 1.0, 2.0)}


def test_zoom_and_shift_of_voxels(spark):
    voxels = volume(spark, 1, 5, lambda t, z, y, x: 2 * z + 3 * y - x)
    out = {(r["z"], r["y"], r["x"]): r["value"] for r in arrays.zoom_voxels(voxels, (2, 2, 2), 2.0).collect()}
    assert len(out) == 125 and all(v == pytest.approx(2 * (2 + (z - 2) / 2) + 3 * (2 + (y - 2) / 2) - (2 + (x - 2) / 2)) for (z, y, x), v in out.items())
    same = {(r["z"], r["y"], r["x"]): r["value"] for r in arrays.zoom_voxels(voxels, (2, 2, 2), 1.0).collect()}
    assert all(v == 2 * z + 3 * y - x for (z, y, x), v in same.items())
    moved = arrays.shift_voxels(volume(spark, 2, 2), {1: (1, -1, 0)}).collect()
    assert {(r["t"], r["z"]) for r in moved} == {(0, 0), (0, 1), (1, 1), (1, 2)} and {r["y"] for r in moved if r["t"] == 1} == {-1, 0}


def test_kinds_of_problems(spark):
    from spoor.operators.objective import constraints, default_constraints

    g = graph(spark, [(1, 0, 0, 0, 0), (2, 1, 0, 0, 0)], [(2, 1)])
    flags = spark.createDataFrame([(2, 1, True)], "source bigint, target bigint, selected boolean")
    assert default_constraints("basic", g.nodes, g.edges).count() == constraints(g.nodes, g.edges).count()
    assert default_constraints("cell_state", g.nodes, g.edges, flags).filter("family = 'pinned'").count() == 1
    with pytest.raises(ValueError):
        default_constraints("other", g.nodes, g.edges)


def test_channels(spark):
    one, two = volume(spark, 1, 2, lambda t, z, y, x: x), volume(spark, 1, 2, lambda t, z, y, x: 10 + x)
    both = arrays.combine_channels(one, two)
    assert {tuple(r["value"]) for r in both.collect()} == {(0.0, 10.0), (1.0, 11.0)} and arrays.stack([one, two]).groupBy("rep").count().count() == 2
    assert {tuple(sorted(r["v"])) for r in both.select(arrays.shuffle_channels(F.col("value"), 3).alias("v")).collect()} == {(0.0, 10.0), (1.0, 11.0)}
    assert arrays.mean_squared_error(spark.createDataFrame([(1.0, 3.0), (2.0, 2.0)], "p double, q double"), "p", "q").first()["mse"] == 2.0


def test_division_reports_store_only_frames_they_compare(spark, monkeypatch):
    from spoor.operators import divisions

    rows = [(1, 3, 0.0, 0.0, 0.0), (2, 4, 9.0, 0.0, 0.0), (3, 50, 0.0, 0.0, 0.0)]
    nodes = spark.createDataFrame(rows, "id bigint, t int, z double, y double, x double")
    plain, seen = divisions.cut, set()

    def watched(df):
        out = plain(df)
        if "t" in out.columns:
            seen.update(r["t"] for r in out.select("t").collect())
        return out

    monkeypatch.setattr(divisions, "cut", watched)
    found = [tuple(r)[:5] for r in division_reports(nodes, nodes, 3, 1.5, 1).orderBy("leniency").collect()]
    assert found == [(0, 1, 1, 0, 0), (1, 1, 1, 0, 0)] and seen == {3, 4}
