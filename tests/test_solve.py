import itertools
import random
from collections import Counter

import pytest
from helpers import pairs
from pyspark.sql import functions as F

from spoor.functions.assignment import best_assignment, total_cost
from spoor.functions.forest import Instance
from spoor.functions.forest import solve as solve_forest
from spoor.functions.roi import Roi, close_to_border
from spoor.operators.greedy import greedy_track
from spoor.operators.objective import SolveParameters
from spoor.operators.solve import solve, solve_blocks

CELLS = [(0, 0, 1, 1, 1, 2.0), (1, 1, 1, 1, 1, 2.0), (2, 2, 1, 1, 0, 2.0), (3, 2, 1, 1, 2, 2.0), (4, 2, 1, 1, 3, 2.0), (5, 3, 1, 1, 2, 2.0)]
EDGES = [(1, 0, 0.0), (2, 1, 1.0), (3, 1, 1.0), (4, 1, 2.0), (5, 3, 0.0)]


def tables(spark, cells=CELLS, edges=EDGES, states=None):
    nodes = spark.createDataFrame([(i, t, float(z), float(y), float(x), s) for i, t, z, y, x, s in cells], "id bigint, t int, z double, y double, x double, score double")
    if states:
        rows = [(i, *[1.0 if i in states[k] else 0.0 for k in ("mother", "daughter", "continuation")]) for i, *_ in cells]
        nodes = nodes.join(spark.createDataFrame(rows, "id bigint, score_mother double, score_daughter double, score_continuation double"), "id")
    return nodes, spark.createDataFrame(edges, "source bigint, target bigint, prediction_distance double")


def chosen(df, param_id=1):
    return pairs(df.filter(f"selected and param_id = {param_id}").select("source", "target"))


def total(df, param_id=1):
    """Cost of all components."""
    return round(sum({r["component"]: r["cost"] for r in df.filter(F.col("param_id") == param_id).collect() if r["component"] is not None}.values()), 9)


def test_basic_and_second_set(spark):
    nodes, edges = tables(spark)
    first = SolveParameters(track_cost=4.0, weight_edge_score=0.1, weight_node_score=-0.1, selection_constant=-1.0)
    second = SolveParameters(track_cost=1.0, weight_edge_score=0.01, weight_node_score=-0.01, selection_constant=-0.1)
    found = solve(nodes, edges, {1: first, 2: second}).cache()
    assert chosen(found) == {(1, 0), (2, 1), (3, 1), (5, 3)}
    assert chosen(found, 2) == {(1, 0), (3, 1), (5, 3)}
    assert total(found, 1) == -4.8 and total(found, 2) == -0.47
    assert {r["gap"] for r in found.collect()} == {0.0}


def test_cell_states(spark):
    p = dict(track_cost=4.0, weight_edge_score=0.1, weight_node_score=-0.1, weight_division=-0.1, weight_child=-0.1, weight_continuation=-0.1, division_constant=1.0, cell_state=True)
    nodes, edges = tables(spark, states={"mother": {1}, "daughter": {2, 3}, "continuation": {0, 4, 5}})
    found = solve(nodes, edges, {1: SolveParameters(selection_constant=-1.0, **p)})
    assert chosen(found) == {(1, 0), (2, 1), (3, 1), (5, 3)} and total(found) == -5.3
    nodes, edges = tables(spark, states={"mother": set(), "daughter": set(), "continuation": set(range(6))})
    found = solve(nodes, edges, {1: SolveParameters(selection_constant=0.0, **p)})
    assert chosen(found) == {(1, 0), (3, 1), (5, 3)} and total(found) == -1.1


def test_pins_hold(spark):
    nodes, edges = tables(spark)
    pins = spark.createDataFrame([(4, 1, True), (2, 1, False)], "source bigint, target bigint, selected boolean")
    p = SolveParameters(track_cost=4.0, weight_edge_score=0.1, weight_node_score=-0.1, selection_constant=-1.0)
    got = chosen(solve(nodes, edges, {1: p}, pins=pins))
    assert (4, 1) in got and (2, 1) not in got


def random_cells(rng, frames, each, side):
    cells = [(f * each + k, f, 0, round(rng.uniform(0, side), 3), round(rng.uniform(0, side), 3), round(rng.uniform(0, 2), 3)) for f in range(frames) for k in range(each)]
    edges = []
    for a in cells:
        for b in cells:
            d = ((a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2) ** 0.5
            if a[1] == b[1] + 1 and d < 3:
                edges.append((a[0], b[0], round(d, 6)))
    return cells, edges


def instance(cells, edges, p, states):
    """The whole problem of all cells as one instance, nothing reduced."""
    first = min(c[1] for c in cells)
    parents = {}
    for v, u, d in edges:
        parents.setdefault(v, []).append((d * p.weight_edge_score, u, None))
    node = lambda f: {c[0]: f(c) for c in cells}
    more = (node(lambda c: states[c[0]][1] * p.weight_child), node(lambda c: states[c[0]][2] * p.weight_continuation)) if p.cell_state else ({}, {})
    split = node(lambda c: states[c[0]][0] * p.weight_division + p.division_constant if p.cell_state else 1.0)
    return Instance(node(lambda c: c[1]), node(lambda c: c[5] * p.weight_node_score + p.selection_constant), node(lambda c: 0.0 if c[1] == first else p.track_cost), split, parents, *more)


@pytest.mark.parametrize("cell_state", [False, True])
def test_reduction_keeps_the_optimum(spark, cell_state):
    rng = random.Random(4)
    for seed in range(2):
        cells, edges = random_cells(rng, 4, 4, 6.0)
        states = {c[0]: [rng.uniform(0, 1) for _ in range(3)] for c in cells}
        p = SolveParameters(track_cost=rng.uniform(0.2, 1.5), weight_edge_score=0.5, weight_node_score=-0.5, selection_constant=-0.3 - 0.3 * seed, weight_division=-1.0, division_constant=0.6, weight_child=-0.4, weight_continuation=-0.3, cell_state=cell_state)
        nodes, links = tables(spark, cells, edges)
        nodes = nodes.join(spark.createDataFrame([(i, *s) for i, s in states.items()], "id bigint, score_mother double, score_daughter double, score_continuation double"), "id")
        found = solve(nodes, links, {1: p}).cache()
        whole = instance(cells, edges, p, states)
        best = solve_forest(whole)[1]
        picked = chosen(found)
        # the flags' own cost, with the best choice of what is left open: pin them all
        pinned = {v: [(c, u, (v, u) in picked) for c, u, _ in ways] for v, ways in whole.parents.items()}
        assert abs(solve_forest(Instance(whole.frame, whole.select, whole.appear, whole.split, pinned, whole.child, whole.go_on))[1] - best) < 1e-9
        assert found.count() == len(edges)


def test_more_costs_and_rules(spark):
    nodes, edges = tables(spark)
    p = SolveParameters(track_cost=4.0, weight_edge_score=0.1, weight_node_score=-0.1, selection_constant=-1.0)
    more = spark.createDataFrame([("edge_selected", 4, 1, -3.0), ("node_selected", 2, None, 9.0)], "kind string, id bigint, other bigint, coef double")
    assert chosen(solve(nodes, edges, {1: p}, more_costs=more)) == {(1, 0), (3, 1), (4, 1), (5, 3)}
    rule = "family string, cid bigint, cid_other bigint, kind string, id bigint, other bigint, coef double, relation string, rhs double"
    no_split = spark.createDataFrame([("no_split", 1, None, "node_split", 1, None, 1.0, "=", 0.0)], rule)
    assert chosen(solve(nodes, edges, {1: p}, rules=no_split)) == {(1, 0), (3, 1), (5, 3)}
    both = spark.createDataFrame([("either", 2, None, "node_selected", 2, None, 1.0, "<=", 1.0), ("either", 2, None, "node_selected", 3, None, 1.0, "<=", 1.0)], rule)
    assert {s for s, _ in chosen(solve(nodes, edges, {1: p}, rules=both))} & {2, 3} == {3}
    with pytest.raises(ValueError, match="rules can be on"):
        solve(nodes, edges, {1: p}, rules=no_split.withColumn("kind", F.lit("node_child")))


def test_blocks(spark):
    rng = random.Random(5)
    cells, edges = random_cells(rng, 8, 4, 9.0)
    nodes, links = tables(spark, cells, edges)
    p = SolveParameters(track_cost=1.2, weight_edge_score=0.5, weight_node_score=-0.5, selection_constant=-0.6)
    whole = chosen(solve(nodes, links, {1: p}))
    by_time = solve_blocks(nodes, links, {1: p}, (4, None, None, None), (2, 0, 0, 0)).cache()
    assert by_time.count() == len(edges) and by_time.select("source", "target").distinct().count() == len(edges)
    got = chosen(by_time)
    assert len({s for s, _ in got}) == len(got) and max(Counter(t for _, t in got).values()) <= 2
    assert len(got ^ whole) <= 4
    assert chosen(solve_blocks(nodes, links, {1: p}, (100, None, None, None), (2, 0, 0, 0))) == whole
    with pytest.raises(ValueError, match="context"):
        solve_blocks(nodes, links, {1: p}, (4, None, None, None), (3, 0, 0, 0))


def test_time_limit_gives_a_gap():
    rng = random.Random(6)
    cells, edges = random_cells(rng, 6, 6, 5.0)
    p = SolveParameters(track_cost=3.0, weight_edge_score=0.3, weight_node_score=-0.5, selection_constant=-0.5)
    made = instance(cells, edges, p, {})
    _, cost, gap = solve_forest(made, most_steps=50)
    assert gap > 0 and cost - gap <= solve_forest(made, most_steps=20_000)[1] <= cost


def test_border(spark):
    nodes, _ = tables(spark, [c if c[0] != 4 else (4, 2, 1, 1, 4, 2.0) for c in CELLS])
    roi = Roi((0, 0, 0, 0), (5, 5, 5, 5))
    assert {r["id"] for r in nodes.filter(close_to_border(roi, 1)).collect()} == {2, 4}


def distance_edges(spark, rows):
    return spark.createDataFrame(rows, "source bigint, target bigint, distance double")


def test_greedy(spark):
    cells = [(0, 0, 1, 1, 1, 2.0), (1, 0, 1, 1, 3, 2.0), (2, 1, 1, 1, 3, 2.0), (3, 1, 1, 1, 1, 2.0), (4, 2, 1, 1, 0, 2.0), (5, 2, 1, 1, 2.1, 2.0)]
    nodes, _ = tables(spark, cells)
    edges = distance_edges(spark, [(3, 0, 0.0), (2, 1, 0.0), (5, 2, 0.9), (4, 3, 1.0), (5, 3, 1.1)])
    assert pairs(greedy_track(nodes, edges, "distance")) == {(3, 0), (2, 1), (4, 3), (5, 2)}
    nodes, _ = tables(spark)
    edges = distance_edges(spark, EDGES)
    assert pairs(greedy_track(nodes, edges, "distance")) == {(1, 0), (3, 1), (5, 3)}
    nodes, _ = tables(spark, [c if c[0] != 3 else (3, 2, 1, 1, 2, 1.0) for c in CELLS])
    edges = distance_edges(spark, EDGES + [(5, 4, 1.0)])
    assert pairs(greedy_track(nodes, edges, "distance", node_threshold=1.5)) == {(1, 0), (4, 1), (5, 4)}


def test_greedy_by_rounds(spark):
    rng = random.Random(8)
    cells, edges = random_cells(rng, 4, 7, 5.0)
    edges = [(v, u, round(d, 0)) for v, u, d in edges]  # with ties
    nodes, _ = tables(spark, cells)
    links = distance_edges(spark, edges)
    for new in (True, False):
        one = pairs(greedy_track(nodes, links, "distance", 0.3, new))
        assert one == pairs(greedy_track(nodes, links, "distance", 0.3, new, few=-1)) and one
        assert one == pairs(greedy_track(nodes, links, "distance", 0.3, new, few=12))  # several runs of frames, and larger frames by rounds


def test_assignment_by_hand_and_by_force():
    assert best_assignment([(1, 1, 10)], 20) == [(1, 1)] and best_assignment([(1, 1, 10)], 3) == []
    assert best_assignment([(1, 1, 10), (1, 2, 15)], 20) == [(1, 1)]
    four = [(1, 1, 10), (2, 2, 10), (1, 3, 12), (3, 2, 14)]
    assert best_assignment(four, 20) == [(1, 1), (2, 2)] and total_cost(four, [(1, 1), (2, 2)], 20) == 60
    assert best_assignment(four, 15) == [(1, 1), (2, 2)]
    rng = random.Random(1)
    for _ in range(150):
        no_match = rng.uniform(1, 10)
        given = [(x, y, rng.uniform(0, 20)) for x in range(rng.randint(1, 4)) for y in range(rng.randint(1, 4)) if rng.random() < 0.7]
        best = min((total_cost(given, [p[:2] for p in some], no_match) for k in range(5) for some in itertools.combinations(given, k) if len({p[0] for p in some}) == len({p[1] for p in some}) == k), default=0)
        assert abs(total_cost(given, best_assignment(given, no_match), no_match) - best) < 1e-9


def by_force(p: Instance) -> float:
    nodes, best = sorted(p.frame), float("inf")
    for how in itertools.product(*[["out", "new", *[(c, u) for c, u, _ in p.parents.get(v, [])]] for v in nodes]):
        made, kids = dict(zip(nodes, how)), {}
        for v, h in made.items():
            if isinstance(h, tuple):
                kids.setdefault(h[1], []).append(v)
        if any(made[u] == "out" or len(k) > 2 for u, k in kids.items()):
            continue
        cost = 0.0
        for v, h in made.items():
            if h == "out":
                continue
            cost += p.select[v] + (p.appear[v] if h == "new" else h[0])
            split = len(kids.get(v, [])) == 2
            if not p.states:
                cost += p.split[v] if split else 0.0
                continue
            child = isinstance(h, tuple) and len(kids[h[1]]) == 2
            cost += (float("inf") if child else p.split[v]) if split else p.child[v] if child else p.go_on[v] if isinstance(h, tuple) else min(p.child[v], p.go_on[v])
        best = min(best, cost)
    return best


def test_forest_by_force():
    rng = random.Random(2)
    for k in range(60):
        frame = {i: rng.randint(0, 2) for i in range(6)}
        parents = {v: [(rng.uniform(-1, 3), u, None) for u in frame if frame[u] == frame[v] - 1 and rng.random() < 0.7] for v in frame}
        draw = lambda a, b: {v: rng.uniform(a, b) for v in frame}
        p = Instance(frame, draw(-4, 1), draw(0, 3), draw(-1, 2), parents, *((draw(-1, 1), draw(-1, 1)) if k % 2 else ({}, {})))
        assert abs(solve_forest(p)[1] - by_force(p)) < 1e-9


def test_blocks_in_the_store_go_on_where_they_stopped(spark, tmp_path, monkeypatch):
    from spoor.operators.solve import TooLarge
    from spoor.plans import tracking
    from spoor.sources.store import GraphStore

    cells, edges = random_cells(random.Random(5), 8, 4, 9.0)
    nodes, links = tables(spark, cells, edges)
    p = SolveParameters(track_cost=1.2, weight_edge_score=0.5, weight_node_score=-0.5, selection_constant=-0.6)
    other = SolveParameters(track_cost=4.0, weight_edge_score=0.1, weight_node_score=-0.1, selection_constant=-1.0)
    store = GraphStore(spark, str(tmp_path / "db"), "w")
    store.write("nodes", nodes, by=["t"])
    store.write("edges", links)
    tracking.solve_store(store, {2: other})
    with pytest.raises(TooLarge):
        tracking.solve_store(store, {1: p}, most_cells=1)
    blocks = dict(size=(4, None, None, None), context=(2, 0, 0, 0), most_cells=1)
    solved, ran = tracking.solve_colour, []

    def once(*a, **b):
        if len(ran) == 1:
            raise RuntimeError("lost")
        ran.append(a[6])
        return solved(*a, **b)

    monkeypatch.setattr(tracking, "solve_colour", once)
    with pytest.raises(RuntimeError):
        tracking.solve_store(store, {1: p}, **blocks)
    ran.append(None)  # goes on, with the second colour only
    tracking.solve_store(store, {1: p}, **blocks)
    assert ran == [(0,), None, (1,)]
    found = store.flags(1, [0, 1])
    assert found.count() == len(edges) and chosen(found) == chosen(solve_blocks(nodes, links, {1: p}, (4, None, None, None), (2, 0, 0, 0)))
    # the other set's flags were not touched, and a whole solve of it does not touch these
    tracking.solve_store(store, {2: other}, from_scratch=True)
    assert store.flags(1, [0, 1]).count() == len(edges) == store.flags(2, [-1]).count()
    store.reset_selection()
    assert store.selected(1)[1].count() == 0


def test_runs_of_frames():
    from spoor.operators.greedy import runs_of

    assert runs_of([9, 8, 7, 6, 5, 4], {9: 3, 8: 4, 6: 9, 5: 1, 4: 2}, 7) == [[9, 8, 7], [6], [5, 4]]
    assert [t for run in runs_of(list(range(30)), {t: t % 5 for t in range(30)}, 6) for t in run] == list(range(30))
