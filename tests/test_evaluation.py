import pytest
from helpers import DIVISION, TRACK, graph, shifted

from spoor.operators.iso import shape
from spoor.plans.tracking import assess, evaluate

A, AE = TRACK
D, DE = DIVISION

# name: annotation cells and edges, reconstruction cells and edges, expected scores
CASES = {
    "perfect": (A, AE, A, AE, dict(matched_edges=3, fp_edges=0, fn_edges=0, gt_tracks=1, rec_tracks=1, aeftl=3, erl=3, precision=1, recall=1, f_score=1, segments={1: (3, 3), 2: (2, 2), 3: (1, 1)})),
    "split": (A, AE, A, [(2, 1), (4, 3)], dict(matched_edges=2, fn_edges=1, rec_tracks=2, aeftl=1, erl=2 / 3, recall=2 / 3, f_score=4 / 5, segments={1: (2, 3), 2: (0, 2), 3: (0, 1)})),
    "missed division": (D, DE, D, [e for e in DE if e != (5, 2)], dict(matched_edges=5, fn_edges=1, fn_divisions=1, aeftl=2.5, erl=13 / 6, segments={1: (5, 6), 2: (2, 4), 3: (0, 2), 4: (0, 1)})),
    "missed division at the root": (
        [c for c in D if c[0] != 1], [e for e in DE if e != (2, 1)], D, [e for e in DE if e != (5, 2)], dict(matched_edges=4, aeftl=2, erl=8 / 5, segments={1: (4, 5), 2: (2, 3), 3: (0, 1)}),
    ),
    "false division": (D, [e for e in DE if e != (5, 2)], D, DE, dict(matched_edges=5, fn_edges=0, fp_divisions=1, aeftl=5 / 3, erl=9 / 5, segments={1: (5, 5), 2: (2, 3), 3: (0, 1)})),
    "false division at the start": (A, AE, A + [(5, 1, 2, 1, 0)], AE + [(5, 1)], dict(matched_edges=3, fp_divisions=1, fn_divisions=0, aeftl=3, erl=3)),
}


@pytest.mark.parametrize("name", CASES)
def test_scores(spark, name):
    gc, ge, rc, re, expected = CASES[name]
    row = evaluate(graph(spark, gc, ge), graph(spark, shifted(rc), re), 2.0).first().asDict(recursive=True)
    segments = expected.pop("segments", None)
    assert {k: row[k] for k in expected} == pytest.approx(expected)
    if segments:
        found = {int(k): (v["correct"], v["total"]) for k, v in row["correct_segments"].items() if v["total"]}
        assert found == segments


ONE_OFF = (
    [(251, 0, 0, 0, 0), (261, 1, 0, 0, 0), (271, 2, 0, 0, 0), (281, 3, 0, 0, 0), (282, 3, 3, 0, 0), (291, 4, 0, 0, 0), (301, 5, 0, 0, 0), (302, 5, -3, 0, 0)],
    [(261, 251), (271, 261), (281, 271), (282, 271), (291, 281), (301, 291), (302, 291)],
    [(2297, 0, 0, 1, 0), (2788, 1, 0, 1, 0), (2944, 2, 0, 1, 0), (2453, 3, 0, 1, 0), (3108, 2, 1, 1, 0), (2990, 3, 3, 1, 0), (2497, 4, 0, 1, 0), (2498, 5, 0, 1, 0), (2499, 5, -3, 1, 0)],
    [(2788, 2297), (2944, 2788), (3108, 2788), (2990, 3108), (2453, 2944), (2497, 2453), (2498, 2497), (2499, 2497)],
)


def test_division_one_frame_off(spark):
    gc, ge, rc, re = ONE_OFF
    gt, rec = graph(spark, gc, ge), graph(spark, rc, re)
    found = assess(gt, rec, 2.0)
    row = found.scores.first()
    assert (row["identity_switches"], row["gt_divisions"], row["fn_divisions"], row["fp_divisions"], row["fn_edges"]) == (0, 2, 1, 1, 0)
    points = {(r["what"], r["id"], r["other"]) for r in found.points.collect()}
    assert ("fp_division", 2788, None) in points and ("tp_division", 291, None) in points
    assert len([p for p in points if p[0] in ("no_connection", "unconnected_child", "unconnected_parent")]) == 1
    assert len([p for p in points if p[0] == "fp_edge"]) == row["fp_edges"] and row["iso_fp_divisions"] == 0
    counted = assess(gt, rec, 2.0, ignore_one_off=True).scores.first()
    assert (counted["fn_divisions"], counted["fp_divisions"], counted["iso_fn_divisions"], counted["iso_fp_divisions"]) == (0, 0, 1, 1)
    assert counted["fp_edges"] <= row["fp_edges"] and (counted["precision"], counted["recall"]) == (row["precision"], row["recall"])


def test_division_one_frame_off_with_a_switch(spark):
    gc, ge, rc, re = ONE_OFF
    gt = graph(spark, gc + [(292, 4, 3, 0, 0)], ge + [(292, 282)])
    row = evaluate(gt, graph(spark, rc + [(2991, 3, 4, 1, 0), (2992, 4, 3, 1, 0)], re + [(2992, 2991)]), 2.0).first()
    assert (row["identity_switches"], row["gt_divisions"], row["fn_divs_unconnected_child"], row["fn_divs_unconnected_parent"], row["fn_divs_no_connections"]) == (1, 2, 1, 0, 0)
    assert (row["fn_divisions"], row["fp_divisions"], row["fn_edges"]) == (1, 1, 0)


def test_several_children_are_an_error(spark):
    g = graph(spark, A + [(8, 1, 0, 0, 1), (9, 1, 0, 0, 2)], AE + [(8, 1), (9, 1)])
    with pytest.raises(ValueError):
        evaluate(g, g, 2.0)


def test_contracted_shapes():
    path, longer = [(1, 2), (2, 3)], [(1, 2), (2, 3), (3, 4), (4, 5)]
    fork, fork2 = [(2, 1), (3, 2), (4, 2)], [(2, 1), (3, 2), (4, 3), (5, 3)]
    assert shape(path) == shape(longer)
    assert shape(fork) == shape(fork2) != shape(path)


def chain(spark, moved=0.0, frames=range(8)):
    rows = [(t + 1, t, float(t % 3), float(t % 5), float(t % 7) + moved) for t in frames]
    return graph(spark, rows, [(b[0], a[0]) for a, b in zip(rows, rows[1:])])


@pytest.mark.parametrize("rec, expected", [(dict(), 0.0), (dict(moved=1.0), 8 / (1 + 9999 ** (49 / 50))), (dict(moved=200.0), 8.0), (dict(frames=range(1, 8)), 1.0), (dict(frames=range(9)), 1.0), (dict(frames=range(20, 28)), 16.0)])
def test_track_distance(spark, rec, expected):
    from spoor.operators.metrics import split_tracks, validation_score

    g, r = chain(spark), chain(spark, **rec)
    rows = validation_score(split_tracks(g.nodes, g.edges), split_tracks(r.nodes, r.edges)).collect()
    assert [row["score"] for row in rows] == pytest.approx([expected], abs=0.01)


def test_no_reconstructed_track_is_an_error(spark):
    from spoor.operators.metrics import split_tracks, validation_score

    g, r = chain(spark), chain(spark, frames=range(1))
    with pytest.raises(Exception, match="no reconstructed track"):
        validation_score(split_tracks(g.nodes, g.edges), split_tracks(r.nodes, r.edges)).collect()


def test_split_gives_two_pieces_and_the_root(spark):
    from spoor.operators.metrics import split_tracks

    g = graph(spark, *DIVISION)
    lengths = sorted(r["count"] for r in split_tracks(g.nodes, g.edges).groupBy("track").count().collect())
    assert lengths == [2, 3, 4]


def test_track_distances_by_force(spark):
    import math
    import random

    rng = random.Random(3)

    def some(n, first):
        rows, edges, k = [], [], first
        for _ in range(n):
            start, length, x = rng.randrange(5), rng.randrange(2, 6), rng.uniform(0, 600)
            for t in range(start, start + length):
                rows.append((k, t, 0.0, 0.0, x + rng.uniform(-9, 9)))
                if t > start:
                    edges.append((k, k - 1))
                k += 1
        return rows, edges

    (gr, ge), (rr, re) = some(12, 0), some(15, 1000)

    def tracks(rows, edges):
        mother = dict(edges)
        root = lambda i: root(mother[i]) if i in mother else i
        out = {}
        for i, t, *at in rows:
            out.setdefault(root(i), {})[t] = at
        return out.values()

    def distance(a, b):
        d = 0.0
        for t in a.keys() | b.keys():
            d += 1 / (1 + math.exp(-math.log(9999) / 50 * (math.dist(a[t], b[t]) - 50))) if t in a and t in b else 1.0
        return d if a.keys() & b.keys() else len(a) + len(b)

    want = sorted(min(distance(a, b) for b in tracks(rr, re)) for a in tracks(gr, ge))
    from spoor.operators.metrics import split_tracks, validation_score

    g, r = graph(spark, gr, ge), graph(spark, rr, re)
    got = sorted(x["score"] for x in validation_score(split_tracks(g.nodes, g.edges), split_tracks(r.nodes, r.edges)).collect())
    assert got == pytest.approx(want, abs=1e-6)


def test_least_outside_by_force(spark):
    """Every pair of spans, against the running minima."""
    import random

    from spoor.operators.metrics import least_outside

    rng = random.Random(8)
    for n in (1, 3, 12):
        span = lambda: tuple(sorted((rng.randrange(3, 20), rng.randrange(3, 20))))
        rec, gt = {span() for _ in range(n)}, {span() for _ in range(25)}
        least = {g: min(r[1] - r[0] + 1 - max(0, min(r[1], g[1]) - max(r[0], g[0]) + 1) for r in rec) for g in gt}
        found = least_outside(spark.createDataFrame(sorted(rec), "from bigint, to bigint"), spark.createDataFrame(sorted(gt), "from bigint, to bigint"))
        assert {(r["from"], r["to"]): r["least"] for r in found.collect()} == least
        assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("share", [0.0, 0.25, 1.0])
def test_distances_of_tracks_with_gaps_by_force(spark, share):
    """Both sides mixed from tracks with and without gaps; tracks of one frame and equal sets of frames occur."""
    import math
    import random

    from spoor.operators.metrics import validation_score

    rng = random.Random(17)

    def some(n):
        out = {}
        for k in range(n):
            start, length, x = rng.randrange(4), rng.randrange(1, 9), rng.uniform(0, 900)
            frames = [t for t in range(start, start + length) if rng.random() >= share / 3 or t == start]
            out[k] = {t: (0.0, 0.0, x + rng.uniform(-9, 9)) for t in frames}
        return out

    def distance(a, b):
        early, late = (a, b) if min(a) <= min(b) else (b, a)
        stop = min(late.keys() - early.keys(), default=math.inf)
        shared = [t for t in late if t < stop]
        return len(a) + len(b) - 2 * len(shared) + sum(1 / (1 + math.exp(-math.log(9999) / 50 * (math.dist(a[t], b[t]) - 50))) for t in shared)

    table = lambda tracks: spark.createDataFrame([(k, t, *at) for k, cells in tracks.items() for t, at in cells.items()], "track bigint, t int, z double, y double, x double")
    gt, rec = some(30), some(20)
    found = validation_score(table(gt), table(rec))
    assert "CartesianProduct" not in found._jdf.queryExecution().toString()
    got = {r["track"]: r["score"] for r in found.collect()}
    assert got == pytest.approx({k: min(distance(a, b) for b in rec.values()) for k, a in gt.items()}, abs=1e-6)


def test_two_cells_of_a_track_in_a_frame_are_an_error(spark):
    from spoor.operators.metrics import validation_score

    rows = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0), (1, 0, 0.0, 0.0, 1.0)], "track bigint, t int, z double, y double, x double")
    with pytest.raises(Exception, match="two cells in a frame"):
        validation_score(rows, rows).collect()


def test_a_division_after_the_end_of_a_track_can_be_exempt(spark):
    """The annotation ends where the reconstruction divides; a second one goes on there elsewhere, so its division counts both ways."""
    cells = [(1, 0, 0, 0, 0), (2, 1, 0, 0, 0)]
    fork = cells + [(3, 2, 60, 0, 0), (4, 2, -60, 0, 0)]
    ends, goes_on = graph(spark, cells, [(2, 1)]), graph(spark, cells + [(5, 2, 0, 0, 0)], [(2, 1), (5, 2)])
    rec = graph(spark, fork, [(2, 1), (3, 2), (4, 2)])
    count = lambda gt, exempt: evaluate(gt, rec, 5.0, exempt_after_end=exempt).first()["fp_divisions"]
    assert [count(ends, False), count(ends, True), count(goes_on, True)] == [1, 0, 1]


def test_tracks_with_a_near_copy_are_not_compared_from_afar(spark, monkeypatch):
    """No pair further away than the first reach can be better, so none is made; a track without a copy goes on."""
    from spoor.operators import metrics

    reaches, join = [], metrics.range_join
    monkeypatch.setattr(metrics, "range_join", lambda left, right, radius, largest, *more, **how: reaches.append(largest) or join(left, right, radius, largest, *more, **how))
    table = lambda rows: spark.createDataFrame(rows, "track bigint, t int, z double, y double, x double")
    copies = [(k, t, 0.0, 0.0, 40.0 * k) for k in range(6) for t in range(3)]
    assert max(r["score"] for r in metrics.validation_score(table(copies), table(copies)).collect()) < 1e-3
    assert reaches == [metrics.REACHES[0]]
    reaches.clear()
    far = [r["score"] for r in metrics.validation_score(table([*copies, (9, 0, 0.0, 0.0, 900.0), (9, 1, 0.0, 0.0, 900.0)]), table(copies)).collect() if r["track"] == 9]
    assert far == [3.0] and reaches == list(metrics.REACHES)
