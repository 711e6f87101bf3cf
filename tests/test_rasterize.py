import math
import random

from spoor.operators.arrays import line_voxels, rasterize_graph

NODES = "id bigint, t int, z double, y double, x double, label bigint"
EDGES = "source bigint, target bigint, label bigint"


def line(a, b):
    n = max(abs(p - q) for p, q in zip(a, b))
    return [tuple(round(p + k * ((q - p) / n)) if n else p for p, q in zip(a, b)) for k in range(n + 1)]  # Python rounds halves to even too


def some(seed, n=25):
    rng = random.Random(seed)
    nodes = [(k, rng.randrange(3), rng.uniform(-9, 9), rng.uniform(0, 12), rng.uniform(0, 30), rng.choice([None, 3, 5, 8])) for k in range(n)]
    edges = [(rng.randrange(n), rng.randrange(n + 2), rng.choice([None, 2, 7])) for _ in range(12)]
    return nodes, sorted(set(edges[:1] + edges), key=str)


def painted(nodes, edges, size):
    at = {i: (t, *(math.floor(c / s) for c, s in zip(place, size))) for i, t, *place, _ in nodes}
    out = {}
    for i, *_, label in sorted(nodes):
        if label is not None:
            out[at[i]] = label
    for s, e, label in sorted((e for e in edges if e[2] is not None)):
        if s in at and e in at:
            for v in line(at[e], at[s]):
                out[v] = label
    return out


def test_lines_by_force(spark):
    size = (2.0, 1.0, 3.0)
    for seed in (1, 2):
        nodes, edges = some(seed)
        edges = list({e[:2]: e for e in edges}.values())
        found = rasterize_graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), size)
        assert {tuple(r)[:4]: r["label"] for r in found.collect()} == painted(nodes, edges, size)


def test_tubes_by_force(spark):
    size, radius = (2.0, 1.0, 3.0), 4.0
    nodes, edges = some(4, 12)
    edges = list({e[:2]: e for e in edges}.values())
    spots, near = painted(nodes, edges, size), {}
    for (t, *p), label in spots.items():
        for dz in range(-2, 3):
            for dy in range(-4, 5):
                for dx in range(-2, 3):
                    d2 = (2 * dz) ** 2 + dy**2 + (3 * dx) ** 2
                    if d2 <= radius**2:
                        v = (t, p[0] + dz, p[1] + dy, p[2] + dx)
                        near[v] = min(near.get(v, (d2, label)), (d2, label))
    run = lambda hollow: {tuple(r)[:4]: r["label"] for r in rasterize_graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), size, radius, hollow).collect()}
    assert run(None) == {v: label for v, (_, label) in near.items()}
    assert run(0.5) == {v: label for v, (d2, label) in near.items() if d2 > 4.0}


def test_plain_and_empty_graphs(spark):
    nodes = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.5), (2, 1, 0.0, 0.0, 0.5), (3, 1, None, 0.0, 2.0)], "id bigint, t int, z double, y double, x double")
    edges = spark.createDataFrame([(2, 1), (2, 2), (3, 1), (9, 1)], "source bigint, target bigint")
    assert {tuple(r) for r in rasterize_graph(nodes, edges).collect()} == {(0, 0, 0, 0, 1), (1, 0, 0, 0, 1)}
    assert {tuple(r) for r in line_voxels(nodes, edges).collect()} == {(2, 1, 0, 0, 0, 0), (2, 1, 1, 0, 0, 0), (2, 2, 1, 0, 0, 0)}
    assert rasterize_graph(nodes.limit(0), edges.limit(0), radius=2.0).count() == 0
    assert rasterize_graph(nodes).count() == 2
