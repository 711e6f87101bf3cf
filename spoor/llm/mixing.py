"""Mix sources to target weights along a time-varying curriculum, with DataFrame operations only.

Targets: every source wants its weight's share of ``budget_ratio`` times all
words, no source more than ``max_repeats`` times its own words; what is above
goes to the others by weight (the fixed point has one level for all sources
below their limit, found from running sums over the sources by limit/weight).

Positions: a source's weight schedule is a list of (time, rate) knots over
[0, 1], linear in between. Its integral is the source's cumulative demand; the
documents of a source stand in an order fixed by a digest of doc_id, and each
is assigned the time at which the demand reaches the words before it. Words
before a document are running sums within (source, digest prefix) cells plus
the sums of the cells before, so that a hot source spreads over many tasks.

A document is taken whole, again from the start when the target exceeds the
source, and the last one only as far as the target reaches, so the words taken
add up to the target (rounded down).

Defined results: null text has size 0; a null source is a source of its own,
last; documents of size 0 are never taken; repeated rows count each; with no
words at all every target is 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, text_of, unpacked, written

WORD = r"[^\x20\x09-\x0D]+"
#: The sources' weights by rank, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: One schedule for each rank, repeating: rising, falling, level.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)))


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_ratio: float = 1.5, max_repeats: float = 2.0) -> DataFrame:
    """One row a source: source, source_size, rank (from 0), target. Windows here run over sources, not documents."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget_ratio)))
        .withColumn("words_left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("full", F.col("cap") * F.col("weight_left") <= F.col("weight") * F.col("words_left"))
    )
    rest_words = F.max("budget").over(everything) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0))
    rest_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * rest_words / rest_weight)
    return levels.select("source", F.col("source_size").cast("bigint").alias("source_size"), "rank", target.alias("target"))


def time_of(demand: Column, knots) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches ``demand`` (a share of the whole, 0 to 1)."""
    areas = [(t1 - t0) * (r0 + r1) / 2 for (t0, r0), (t1, r1) in zip(knots, knots[1:])]
    total, done, out = sum(areas), 0.0, None
    for (t0, r0), (t1, r1), area in zip(knots, knots[1:], areas):
        left = demand * total - done  # rate r0 + slope x: slope/2 x^2 + r0 x = left
        slope = (r1 - r0) / (t1 - t0)
        x = left / r0 if slope == 0 else 2 * left / (r0 + F.sqrt(F.greatest(F.lit(r0 * r0) + 2 * slope * left, F.lit(0.0))))
        here = t0 + F.greatest(x, F.lit(0.0))
        done += area
        out = F.when(demand * total <= done, here) if out is None else out.when(demand * total <= done, here)
    return out.otherwise(F.lit(float(knots[-1][0])))


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, budget_ratio: float = 1.5, max_repeats: float = 2.0, rows_per_cell: int = 50_000) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, positions (of its first and later takes), fingerprint, in the order of the mix."""
    text = text_of()
    sizes = written(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), F.xxhash64(text).alias("content"))
        .withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))), "mix-sizes"
    )
    digits, rows = 3, sizes.count()
    while rows > rows_per_cell * 16 ** (digits - 1):
        digits += 1
    targets = written(source_targets(sizes, weights, budget_ratio, max_repeats), "mix-targets")
    placed = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"]).withColumn("cell", F.substring("key", 1, digits))
    cells = placed.groupBy("rank", "cell").agg(F.sum("size").alias("cell_size"))
    cells = cells.withColumn("words_before", F.sum("cell_size").over(Window.partitionBy("rank").orderBy("cell")) - F.col("cell_size")).drop("cell_size")
    inside = Window.partitionBy("rank", "cell").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "content").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = placed.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(cells, ["rank", "cell"])
    start = F.col("words_before") + F.col("inside")
    goal = F.floor("target").cast("bigint")
    rounds = [start + F.lit(k) * F.col("source_size") for k in range(max(1, int(-(-max_repeats // 1))))]
    takes = [F.greatest(F.lit(0), F.least(F.col("size"), goal - r)).cast("bigint") for r in rounds]
    times = F.array(*[
        F.when(t > 0, _by_rank(r / F.col("target"), schedules)) for r, t in zip(rounds, takes)
    ])
    out = at.select(
        "doc_id", "content", "size", "source_size", "target", sum(takes[1:], takes[0]).alias("taken"), F.array(*takes).alias("takes"), times.alias("times"),
        (F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2**32 + 1).alias("unused"),
    )
    # Documents that are not taken follow the others, spread by their digest.
    return out.withColumn("position", F.col("times")[0]).withColumn("place", F.coalesce("position", "unused")).orderBy("place", "doc_id").drop("unused", "place")


def _by_rank(demand: Column, schedules) -> Column:
    out = None
    for k, knots in enumerate(schedules):
        here = F.col("rank") % len(schedules) == k
        out = F.when(here, time_of(demand, knots)) if out is None else out.when(here, time_of(demand, knots))
    return out


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: documents in order of training position, whole, once for each of their takes.

    A source's last take, which may be a part of a document in the plan, is the
    whole document here, so a source can exceed its target by less than one
    document; none is repeated more often than planned. Partitions are ranges of
    positions and sorted, so the order of files and rows is the training order.
    """
    plan = mix(docs, **how).select(F.col("doc_id").alias("mid"), F.col("content").alias("mcontent"), F.filter("times", lambda t: t.isNotNull()).alias("at")).filter(F.size("at") > 0)
    # Repeated rows (one id and text) each have takes of their own; the copies of one row stand for all.
    plan = written(plan.groupBy("mid", "mcontent").agg(F.flatten(F.collect_list("at")).alias("at"), F.count(F.lit(1)).alias("times")), "mix-plan")
    rows = packed(docs, rid=F.col("doc_id").cast("bigint"), rcontent=F.xxhash64(text_of()))
    same = F.col("rid").eqNullSafe(F.col("mid")) & (F.col("rcontent") == F.col("mcontent"))
    found = rows.join(plan.filter("times = 1"), same)
    if not (repeated := plan.filter("times > 1")).isEmpty():
        found = found.unionByName(rows.dropDuplicates(["rid", "rcontent"]).join(repeated, same))
    return unpacked(found.select("row", "rid", F.explode("at").alias("place")).orderBy("place", "rid"), docs)
