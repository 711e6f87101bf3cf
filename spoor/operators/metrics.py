"""Errors of a reconstruction against an annotation, from the matched edges.

Here x is the annotation (gt) and y the reconstruction (rec). ``matches`` has
x_source, x_target, y_source, y_target. All are joins and groupings by node.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.roi import distance2
from ..plans.components import connected_components, cut
from .graph import divisions, split_edges, tracks
from .spatial import range_join


def fn_edges(gt_edges: DataFrame, matches: DataFrame) -> DataFrame:
    return gt_edges.select("source", "target").join(matches.select(F.col("x_source").alias("source"), F.col("x_target").alias("target")), ["source", "target"], "left_anti")


def fp_edges(rec_edges: DataFrame, matches: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Unmatched reconstructed edges; against a sparse annotation only those that had a candidate."""
    edges = rec_edges if candidates is None else candidates
    return edges.select("source", "target").join(matches.select(F.col("y_source").alias("source"), F.col("y_target").alias("target")), ["source", "target"], "left_anti")


def track_matches(gt, rec, matches: DataFrame) -> DataFrame:
    """(gt_track, rec_tracks): for each annotated track with a matched edge, the reconstructed tracks it is matched to."""
    g, r = tracks(gt.nodes, gt.edges, isolated=False), tracks(rec.nodes, rec.edges, isolated=False)
    found = matches.join(g.toDF("x_source", "gt_track"), "x_source").join(r.toDF("y_source", "rec_track"), "y_source")
    return found.groupBy("gt_track").agg(F.array_sort(F.collect_set("rec_track")).alias("rec_tracks"))


def identity_switches(gt_edges: DataFrame, matches: DataFrame) -> DataFrame:
    """Annotated nodes with one edge each way, both matched, whose matched edges do not meet in one reconstructed node."""
    ahead = gt_edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("next"))
    back = gt_edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("p"), F.min("target").alias("prev"))
    one = ahead.join(back, "id").filter("n = 1 and p = 1")
    m = matches.select("x_source", "x_target", "y_source", "y_target")
    found = one.join(m.select(F.col("x_source").alias("next"), F.col("x_target").alias("id"), F.col("y_target").alias("next_meets")), ["next", "id"])
    found = found.join(m.select(F.col("x_source").alias("id"), F.col("x_target").alias("prev"), F.col("y_source").alias("prev_meets")), ["id", "prev"])
    return found.filter("next_meets <> prev_meets").select("id")


def _same(a: str, b: str) -> Column:
    """Equality that is false where a side is missing."""
    return F.coalesce(F.col(a) == F.col(b), F.lit(False))


def fp_divisions(rec_edges: DataFrame, matches: DataFrame, sparse: bool = True, gt_edges: DataFrame | None = None) -> DataFrame:
    """(id, c1, c2): reconstructed divisions whose child edges are not matched to annotated edges of one target; c1 and c2 are those targets.

    Against a sparse annotation a division without a matched child counts only if
    its edge back in time is matched; with ``gt_edges``, only if the annotated
    track goes on there as well, so a division after its end is none of its errors.
    """
    found = divisions(rec_edges)
    y = matches.select("y_source", "y_target", "x_target")
    for k in (1, 2):
        found = found.join(y.select(F.col("y_source").alias(f"child{k}"), F.col("y_target").alias("parent"), F.col("x_target").alias(f"c{k}")), [f"child{k}", "parent"], "left")
    inside = matches if gt_edges is None else matches.join(gt_edges.select(F.col("target").alias("x_source")), "x_source", "left_semi")
    back = inside.select(F.col("y_source").alias("parent"), F.lit(True).alias("back")).distinct()
    found = found.join(back, "parent", "left").filter(~_same("c1", "c2"))
    if sparse:
        found = found.filter("c1 is not null or c2 is not null or back")
    return found.select(F.col("parent").alias("id"), "c1", "c2")


def fn_divisions(gt_edges: DataFrame, matches: DataFrame, count_unconnected_parent: bool = True) -> DataFrame:
    """(id, result, unconnected_parent): one row an annotated division. result is tp, no_connection, unconnected_child or unconnected_parent."""
    found = divisions(gt_edges)
    x = matches.select("x_source", "x_target", "y_source", "y_target")
    for k in (1, 2):
        found = found.join(x.select(F.col("x_source").alias(f"child{k}"), F.col("x_target").alias("parent"), F.col("y_target").alias(f"c{k}")), [f"child{k}", "parent"], "left")
    back = gt_edges.select(F.col("source").alias("parent"), F.col("target").alias("grand"))
    found = found.join(back, "parent", "left").join(x.select(F.col("x_source").alias("parent"), F.col("x_target").alias("grand"), F.col("y_source").alias("p")), ["parent", "grand"], "left")
    root, equal, first, second = F.col("grand").isNull(), _same("c1", "c2"), _same("c1", "p"), _same("c2", "p")
    loose = ~root & equal & ~first
    result = (
        F.when(equal & (root | first), "tp").when(loose, "unconnected_parent" if count_unconnected_parent else "tp")
        .when(~root & (first | second), "unconnected_child").otherwise("no_connection")
    )
    return found.select(F.col("parent").alias("id"), result.alias("result"), loose.alias("unconnected_parent"))


def f_score(n_gt: Column, n_rec: Column, n_matched: Column) -> list[Column]:
    """precision, recall and F, each 0 where it has no denominator; ``n_rec`` counts matched and false edges."""
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))
    precision, recall = share(n_matched, n_rec), share(n_matched, n_gt)
    f = F.when(precision + recall == 0, F.lit(0.0)).otherwise(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)))
    return [precision.alias("precision"), recall.alias("recall"), f.alias("f_score")]


def aeftl_erl(gt_edges: DataFrame, rec_edges: DataFrame, matches: DataFrame, fp_division_ids: DataFrame) -> DataFrame:
    """One row (aeftl, erl): mean length of error-free pieces, and their squared lengths over the annotated edges.

    Pieces are components of the matched reconstructed edges; at a false
    division with edges both ways the edge back in time moves to a fresh node.
    """
    kept = cut(matches.select(F.col("y_source").alias("source"), F.col("y_target").alias("target")).distinct())
    ahead = kept.select(F.col("target").alias("id")).distinct()
    moved = fp_division_ids.select("id").distinct().join(ahead, "id", "left_semi").withColumnRenamed("id", "source").withColumn("_moved", F.lit(True))
    ends = kept.join(moved, "source", "left").select(F.when(F.col("_moved"), F.concat(F.lit("cut/"), F.col("source").cast("string"))).otherwise(F.col("source").cast("string")).alias("a"), F.col("target").cast("string").alias("b"))
    pieces = ends.join(connected_components(ends).withColumnRenamed("node", "a"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    total = gt_edges.agg(F.count(F.lit(1)).alias("n_gt"))
    lengths = pieces.agg(F.avg("n").alias("aeftl"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return lengths.join(total).select(F.coalesce("aeftl", F.lit(0.0)).alias("aeftl"), F.coalesce(F.col("squares") / F.nullif(F.col("n_gt"), F.lit(0)), F.lit(0.0)).alias("erl"))


def perfect_segments(gt_edges: DataFrame, wrong_edges: DataFrame, wrong_nodes: DataFrame, window: int) -> DataFrame:
    """(depth, correct, total): for each edge and each depth up to ``window``, whether the tree ahead of it down to that depth has no
    missing edge and, apart from the start node, no node with an error. Once wrong, a window stays wrong.

    One join a depth; a division splits a walk, and walks of one start edge are brought together by a maximum.
    """
    bad_edge = wrong_edges.select("source", "target").distinct().withColumn("be", F.lit(1))
    bad_node = wrong_nodes.select(F.col("id").alias("source")).distinct().withColumn("bn", F.lit(1))
    # An edge's ahead node is its source. Passing through a node with an error makes the next depth wrong.
    told = cut(gt_edges.select("source", "target").join(bad_edge, ["source", "target"], "left").join(bad_node, "source", "left").select("source", "target", F.coalesce("be", F.lit(0)).alias("be"), F.coalesce("bn", F.lit(0)).alias("bn")))
    state = told.select(F.col("source").alias("s"), F.col("target").alias("p"), F.col("source").alias("at"), F.col("be").alias("bad"), F.col("bn").alias("through"))
    rows = []
    for depth in range(1, window + 1):
        whole = state.groupBy("s", "p").agg(F.max("bad").alias("bad"))
        rows.append(whole.agg(F.count(F.when(F.col("bad") == 0, 1)).alias("correct"), F.count(F.lit(1)).alias("total")).select(F.lit(depth).alias("depth"), "correct", "total"))
        if depth < window:
            walk = state.join(whole.select(F.col("s").alias("s2"), F.col("p").alias("p2"), F.col("bad").alias("before")), (F.col("s") == F.col("s2")) & (F.col("p") == F.col("p2")))
            following = told.select(F.col("target").alias("meets"), F.col("source").alias("goes"), F.col("be").alias("next_be"), F.col("bn").alias("next_bn"))
            state = cut(walk.join(following, F.col("at") == F.col("meets")).select("s", "p", F.col("goes").alias("at"), F.greatest("before", "through", "next_be").alias("bad"), F.col("next_bn").alias("through")))
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


def norm_distance(distance: Column, inflection: float = 50.0) -> Column:
    """A logistic of the distance: 1e-4 at 0, one half at the inflection, near 1 far beyond it."""
    slope = log(9999.0) / inflection
    return 1.0 / (1.0 + F.exp(-slope * (distance - inflection)))


def split_tracks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(track, t, z, y, x): the nodes of each track once divisions are split; a copy of a dividing node stands at its place in each branch."""
    ends = cut(split_edges(edges))
    pieces = connected_components(ends.select(F.col("near_source").alias("a"), F.col("near_target").alias("b")))
    at = ends.select(F.col("near_source").alias("node"), F.col("source").alias("id")).union(ends.select("near_target", "target")).distinct()
    return at.join(pieces, "node").join(nodes.select("id", "t", "z", "y", "x"), "id").select(F.col("component").alias("track"), "t", "z", "y", "x")


#: Beyond this distance (at inflection 50) a normed distance is 1 to within 1e-9.
FAR = 50.0 + 50.0 * log(1e9) / log(9999.0)


def least_outside(spans: DataFrame, asked: DataFrame) -> DataFrame:
    """(from, to, least) of every span of frames in ``asked`` (from, to): the least number of frames that one of ``spans`` has outside it.

    A span inside has none; one that begins and ends earlier has at most the
    frames before ``from``, one that begins and ends later at most those behind
    ``to``, one around it those on both sides; one that does not touch has all
    its frames. Each is a least or greatest over spans that begin and end on one
    side of (from, to): running minima along one axis of a table of all pairs of
    frames, then along the other. The table grows with the square of the number
    of frames, and no window has more rows than frames.
    """
    both = spans.select("from", "to").union(asked.select("from", "to")).agg(F.min("from").alias("low"), F.max("to").alias("high")).first()
    low, high = both["low"], both["high"]
    if low is None:
        return asked.select("from", "to", F.lit(None).cast("bigint").alias("least"))
    there = spans.select(F.col("from").cast("bigint").alias("from"), F.col("to").cast("bigint").alias("to")).distinct().withColumn("is", F.lit(True))
    frames = F.sequence(F.lit(low).cast("bigint"), F.lit(high).cast("bigint"))
    pairs = spans.sparkSession.range(low, high + 1).select(F.col("id").alias("from"), F.explode(frames).alias("to")).join(there, ["from", "to"], "left")
    begin, end, span = (F.when(F.col("is"), c) for c in (F.col("from"), F.col("to"), F.col("to") - F.col("from")))
    one = lambda up: Window.partitionBy("from").orderBy("to" if up else F.desc("to"))
    two = lambda up: Window.partitionBy("to").orderBy("from" if up else F.desc("from"))
    along = pairs.select(
        "from", "to", F.max(begin).over(one(True)).alias("earlier"), F.min(end).over(one(False)).alias("later"), F.max(begin).over(one(True)).alias("inside"), F.min(span).over(one(False)).alias("around"),
    )
    table = along.select(
        "from", "to", F.max("earlier").over(two(True)).alias("earlier"), F.min("later").over(two(False)).alias("later"), F.max("inside").over(two(False)).alias("inside"), F.min("around").over(two(True)).alias("around"),
    )
    # One row a frame.
    length = F.col("to") - F.col("from") + 1
    before = there.groupBy("to").agg(F.min(length).alias("n")).select((F.col("to") + 1).alias("frame"), "n")
    behind = there.groupBy("from").agg(F.min(length).alias("n")).select((F.col("from") - 1).alias("frame"), "n")
    each = spans.sparkSession.range(low, high + 1).withColumnRenamed("id", "frame")
    running = lambda rows, name, order: each.join(rows, "frame", "left").select("frame", F.min("n").over(Window.orderBy(order)).alias(name))
    out = asked.select("from", "to").distinct().join(table, ["from", "to"])
    out = out.join(running(before, "before", F.col("frame")).withColumnRenamed("frame", "from"), "from", "left").join(running(behind, "behind", F.desc("frame")).withColumnRenamed("frame", "to"), "to", "left")
    ways = [F.when(F.col("inside").isNotNull(), F.lit(0)), F.col("from") - F.col("earlier"), F.col("later") - F.col("to"), F.col("around") - (F.col("to") - F.col("from")), F.col("before"), F.col("behind")]
    return out.select("from", "to", F.least(*ways).cast("bigint").alias("least"))


def frame_runs(cells: DataFrame) -> DataFrame:
    """(track, n, from, to, runs, gaps) of (track, t): the frames of each track as runs [(from, to)] of frames without a gap, in order; two cells of one track in a frame are an error."""
    placed = cells.select("track", F.col("t").cast("bigint").alias("t"), F.dense_rank().over(Window.partitionBy("track").orderBy("t")).alias("k"))
    runs = placed.groupBy("track", (F.col("t") - F.col("k")).alias("_run")).agg(F.min("t").alias("from"), F.max("t").alias("to"), F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("n", F.when(F.col("n") != F.col("to") - F.col("from") + 1, F.raise_error(F.lit("a track has two cells in a frame")).cast("bigint")).otherwise(F.col("n")))
    told = runs.groupBy("track").agg(F.sum("n").alias("n"), F.min("from").alias("from"), F.max("to").alias("to"), F.array_sort(F.collect_list(F.struct("from", "to"))).alias("runs"))
    return told.withColumn("gaps", F.size("runs") > 1)


def with_stop(pairs: DataFrame) -> DataFrame:
    """``pairs`` (g_runs, r_runs, ...) with ``stop`` and ``together``: two tracks are compared up to the first frame that the one which begins later has and the other has not.

    That frame is ``stop`` (null where there is none), and the frames of the
    later one before it, all of them common, number ``together``. Of two that
    begin together the annotated one counts as the earlier.
    """
    begins = lambda c: F.element_at(c, 1)["from"]
    first = begins(F.col("g_runs")) <= begins(F.col("r_runs"))
    rows = pairs.withColumn("_early", F.when(first, F.col("g_runs")).otherwise(F.col("r_runs"))).withColumn("_late", F.when(first, F.col("r_runs")).otherwise(F.col("g_runs")))

    def missing(run: Column) -> Column:
        there = F.filter("_early", lambda e: (e["from"] <= run["from"]) & (run["from"] <= e["to"]))
        end = F.get(there, F.lit(0))["to"]
        return F.when(end.isNull(), run["from"]).when(end < run["to"], end + 1)

    rows = rows.withColumn("stop", F.array_min(F.transform("_late", missing)))
    before = lambda run: F.greatest(F.lit(0), F.least(run["to"], F.col("stop") - 1) - run["from"] + 1)
    return rows.withColumn("together", F.aggregate("_late", F.lit(0).cast("bigint"), lambda n, run: n + before(run))).drop("_early", "_late")


def _least_with_gaps(kinds_g: DataFrame, kinds_r: DataFrame) -> DataFrame:
    """(g_runs, with_gaps): the least number of frames that a reconstructed track compared with one of these frames has outside those compared, over pairs with a gap on either side.

    Only pairs whose later one begins in a frame of the other compare any: a
    join by that frame, of the distinct sets of frames on either side.
    """
    g, r = kinds_g.withColumn("g_from", F.element_at("g_runs", 1)["from"]), kinds_r.withColumn("r_from", F.element_at("r_runs", 1)["from"])
    at = lambda runs: F.explode(F.flatten(F.transform(runs, lambda run: F.sequence(run["from"], run["to"])))).alias("at")
    r_later = g.select("*", at("g_runs")).join(r, F.col("at") == F.col("r_from"))
    g_later = r.select("*", at("r_runs")).join(g, (F.col("at") == F.col("g_from")) & (F.col("r_from") < F.col("g_from")))
    columns = ["g_runs", "r_runs", "r_n"]
    some = lambda d: d.filter((F.size("g_runs") > 1) | (F.size("r_runs") > 1)).select(*columns)
    return with_stop(some(r_later).union(some(g_later))).groupBy("g_runs").agg(F.min(F.col("r_n") - F.col("together")).alias("with_gaps"))


#: Distances at which reconstructed tracks are looked for, one after the other, until none further away can be better.
REACHES = (15.0, 50.0, 75.0, FAR)


def _least_scores(pairs: DataFrame, g: DataFrame, r: DataFrame, ng: DataFrame, nr: DataFrame, open_: DataFrame) -> DataFrame:
    """(g_track, found): the least distance of each annotated track over its ``pairs`` (a_id, b_id). Pairs that could not come below ``near`` of ``open_`` if they lay at one place are left out."""
    rows = pairs.join(ng.hint("merge"), F.col("a_id") == F.col("g_track")).join(open_.select(F.col("g_track").alias("_o"), "near").hint("merge"), F.col("a_id") == F.col("_o"))
    rows = with_stop(rows.join(nr.hint("merge"), F.col("b_id") == F.col("r_track"))).withColumn("far", (F.col("g_n") + F.col("r_n") - 2 * F.col("together")).cast("double"))
    rows = rows.filter((F.col("together") > 0) & (F.col("near").isNull() | (F.col("far") < F.col("near")))).select("a_id", "b_id", "stop", "far")
    at = lambda d, p: d.select(F.col("track").alias(p + "track"), F.col("t").alias(p + "t"), *[F.col(c).cast("double").alias(p + c) for c in ("z", "y", "x")]).hint("merge")
    rows = rows.join(at(r, "b_"), (F.col("b_id") == F.col("b_track")) & (F.col("stop").isNull() | (F.col("b_t") < F.col("stop"))))
    rows = rows.join(at(g, "a_"), (F.col("a_id") == F.col("a_track")) & (F.col("b_t") == F.col("a_t"))).select("a_id", "b_id", "far", norm_distance(F.sqrt(distance2())).alias("d"))
    whole = rows.groupBy("a_id", "b_id").agg((F.first("far") + F.sum("d")).alias("d"))
    return whole.groupBy(F.col("a_id").alias("g_track")).agg(F.min("d").alias("found"))


def validation_score(gt_tracks: DataFrame, rec_tracks: DataFrame) -> DataFrame:
    """(track, score): for each annotated track the least distance to a reconstructed one.

    Two tracks are compared in the c frames they share up to the first one that
    the later of them has alone (``with_stop``); without gaps these are all the
    frames they share. The distance is n1 + n2 - 2c + the sum over the c frames
    of the normed distances. One that is further away than R in each of them has
    at least n1 times the normed R, as c is at most n1 and n2. So pairs come from
    range joins at growing ``REACHES``, each for tracks alone whose least
    distance so far could still be undercut from further away, no further than
    that, and without pairs whose frames alone keep them above it. Beyond ``FAR`` a frame counts as 1 to within 1e-9, and a pair
    depends on the frames alone: for the tracks left over (n1 or nearly n1 is
    their least) this comes from ``least_outside``, a table with a row for each
    pair of frames, or with gaps from a join of distinct sets of frames. Two
    cells of one track in a frame are an error, and so is no reconstructed track
    at all.
    """
    number = lambda d, p: d.select(F.col("track").alias(p + "id"), F.col("t").alias(p + "t"), *[F.col(c).alias(p + c) for c in ("z", "y", "x")])
    g, r = cut(gt_tracks), cut(rec_tracks)
    spans = lambda d, p: cut(frame_runs(d).select(*[F.col(c).alias(p + c) for c in ("track", "n", "from", "to", "runs", "gaps")]))
    ng, nr = spans(g, "g_"), spans(r, "r_")
    shortest = nr.agg(F.min("r_n")).first()[0]
    if shortest is None:
        raise ValueError("no reconstructed track")
    span = ["g_n", "g_from", "g_to"]
    open_, done = ng.select("g_track", *span, F.lit(None).cast("double").alias("near")), []
    b = cut(number(r, "b_").join(nr.select(F.col("r_track").alias("b_id"), "r_n", "r_from", "r_to").hint("merge"), "b_id"))
    # At most so many frames are compared, and this one, if it is, adds its normed distance.
    most = F.least("g_n", "r_n", F.least("g_to", "r_to") - F.greatest("g_from", "r_from") + 1)
    may = F.col("near").isNull() | (F.col("g_n") + F.col("r_n") - 2 * most + norm_distance(F.sqrt(distance2())) < F.col("near"))
    share, near, slope = F.col("near") / F.col("g_n"), F.col("near"), log(9999.0) / 50.0
    for reach in REACHES:
        own = F.when(share < 1 - 1e-9, F.least(F.lit(reach), 50.0 + F.log(share / (1 - share)) / slope + 1e-6)).otherwise(F.lit(reach))
        asked = number(g, "a_").join(open_.select(F.col("g_track").alias("a_id"), *span, "near", own.alias("reach")).hint("merge"), "a_id")
        pairs = range_join(asked, b, F.col("reach"), reach).filter(may).select("a_id", "b_id").repartition("a_id").distinct()
        found = _least_scores(pairs, g, r, ng, nr, open_)
        now = cut(open_.join(found.hint("merge"), "g_track", "left").select("g_track", *span, F.least("near", "found").alias("near")))
        settled = F.coalesce(near <= F.col("g_n") * norm_distance(F.lit(reach)), F.lit(False))
        done.append(now.filter(settled).select("g_track", "near"))
        open_ = now.filter(~settled)
        if open_.isEmpty():
            break
    else:
        done.append(_with_far(open_, ng, nr, shortest))
    return reduce(DataFrame.union, done).select(F.col("g_track").alias("track"), F.col("near").alias("score"))


def _with_far(open_: DataFrame, ng: DataFrame, nr: DataFrame, shortest: int) -> DataFrame:
    """(g_track, near) of the tracks in ``open_``, with those reconstructed tracks as well that are near in no frame."""
    out = ng.join(open_.select("g_track", "near").hint("merge"), "g_track")
    gaps = not (out.filter("g_gaps").isEmpty() and nr.filter("r_gaps").isEmpty())
    whole_g, whole_r = (out.filter("not g_gaps"), nr.filter("not r_gaps")) if gaps else (out, nr)
    table = least_outside(whole_r.select(F.col("r_from").alias("from"), F.col("r_to").alias("to")), whole_g.select(F.col("g_from").alias("from"), F.col("g_to").alias("to")))
    by_kind = table.select(F.col("from").alias("g_from"), F.col("to").alias("g_to"), "least")
    found = out.join(by_kind, ["g_from", "g_to"], "left").withColumn("least", F.when(~F.col("g_gaps"), F.col("least")))
    if gaps:
        kinds_g, kinds_r = cut(out.select("g_runs").distinct()), cut(nr.select("r_runs", "r_n").distinct())
        found = found.join(_least_with_gaps(kinds_g, kinds_r), "g_runs", "left").withColumn("least", F.least("least", "with_gaps"))
    anyone = (F.col("g_n") + F.least("least", F.lit(shortest))).cast("double")
    return found.select("g_track", F.least("near", anyone).alias("near"))
