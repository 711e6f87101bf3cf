"""A Merkle manifest of a dataset, its leaves placed by bitmap ranks, DataFrame operations only.

A row's leaf is the digest of its columns, each written as its byte count, a
colon and its value. The leaves of a source, by rising doc_id, are reduced in
runs of three to a subroot; the subroots, by source, likewise to the root.

1. Per source the doc_ids form a compressed bitmap: of each 64 ids that have one
   at all, a word of 64 bits, made by OR, which partial groupings merge before
   the shuffle. Words are kept by container of 2^16 ids.
2. A popcount directory says how many rows of the source lie before each word:
   sums inside a container, and inside 2^16 containers, 2^32, and so on, so that
   no window has more than 2^16 rows, however many ids a source has.
3. The rank of an id, its leaf's place, is the directory's number for its word
   and the bits below it: rows are not sorted. Ids that occur more than once are
   found by words with more rows than bits; only those are numbered, by leaf.
4. Nodes go by (tree, place / 81) into groups of 81 slots, and each group reduces
   four levels at once. Going back from the top, a group hands its path to the
   slots of the groups below, so that every leaf gets its siblings.

Defined results: null ids come first in their source; rows of one id come by
leaf, and equal rows have proofs of their own; the null source is the first; a
row without an id is not tampered with; a source of one row is its own subroot,
and a table of one source has that source's subroot as root; an empty table
gives no rows; columns other than the five are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import dense_numbers
from ..plans.components import join_by_key
from .common import broadcast_if_small, written

#: Children of a node, and levels that a group of slots reduces at once.
WAYS, LEVELS = 3, 4
SLOTS = WAYS**LEVELS
#: Containers that a join may broadcast: 20 kB each at most.
FEW_CONTAINERS = 4096
#: Trees whose paths a join may broadcast: about 1 kB each.
FEW_PATHS = 20_000


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value as the leaf sees it: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return sha(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]))


def tampers(doc_id: Column) -> Column:
    """Whether 2 divides the unsigned crc32 of the decimal id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, presented): presented is the leaf of the row as it is found later."""
    doc_id, n_chars = F.col("doc_id").cast("bigint"), F.col("n_chars").cast("bigint")
    made = [leaf(doc_id, F.col("source"), F.col("lang"), n_chars, text) for text in (F.col("text"), F.replace(F.col("text"), F.lit("\n"), F.lit("")))]
    changed = tampers(doc_id) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    return docs.select(doc_id.alias("doc_id"), F.col("source").cast("string").alias("source"), made[0].alias("leaf"), F.when(changed, made[1]).alias("presented"))


def bitmaps(ids: DataFrame) -> DataFrame:
    """(tree, container, words): of (tree, doc_id) the nonzero words of 64 ids by container of 2^16, as (place, bits, rows)."""
    word = ids.groupBy("tree", F.shiftright("doc_id", 16).alias("container"), F.shiftright("doc_id", 6).bitwiseAND(1023).cast("int").alias("place")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("doc_id").bitwiseAND(63).cast("int"))).alias("bits"), F.count(F.lit(1)).alias("rows")
    )
    return word.groupBy("tree", "container").agg(F.array_sort(F.collect_list(F.struct("place", "bits", "rows"))).alias("words"))


def directory(maps: DataFrame) -> DataFrame:
    """(tree, container, places, bits, before): for each word of a bitmap how many rows of its tree come before it.

    A container's number has 48 bits: sums go by its last 16, the 16 before them
    and the first 16, each window within one number of the level above.
    """
    size = F.aggregate("words", F.lit(0).cast("bigint"), lambda n, w: n + w["rows"])
    level = maps.select("tree", "container", size.alias("rows"), F.shiftright("container", 16).alias("upper"), F.shiftright("container", 32).alias("top"))
    before = lambda by, order: F.sum("rows").over(Window.partitionBy(*by).orderBy(order)) - F.col("rows")
    inner = level.select("tree", "container", "upper", before(("tree", "upper"), "container").alias("b0"))
    upper = level.groupBy("tree", "upper", "top").agg(F.sum("rows").alias("rows"))
    middle = upper.select("tree", "upper", "top", before(("tree", "top"), "upper").alias("b1"))
    top = upper.groupBy("tree", "top").agg(F.sum("rows").alias("rows")).select("tree", "top", before(("tree",), "top").alias("b2"))
    base = inner.join(middle, ["tree", "upper"]).join(top, ["tree", "top"]).select("tree", "container", (F.col("b0") + F.col("b1") + F.col("b2")).alias("base"))
    start = F.struct(F.array().cast("array<bigint>").alias("before"), F.col("base").alias("n"))
    sums = F.aggregate("words", start, lambda a, w: F.struct(F.concat(a["before"], F.array(a["n"])).alias("before"), (a["n"] + w["rows"]).alias("n")))["before"]
    return maps.join(base, ["tree", "container"]).select("tree", "container", F.col("words.place").alias("places"), F.col("words.bits").alias("bits"), sums.alias("before"))


def rank(doc_id: Column, places: Column, bits: Column, before: Column) -> Column:
    """How many rows of the tree have a lesser id, if ids do not repeat."""
    at = (F.array_position(places, F.shiftright(doc_id, 6).bitwiseAND(1023).cast("int")) - 1).cast("int")
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), doc_id.bitwiseAND(63).cast("int")))
    return F.get(before, at) + F.bit_count(F.get(bits, at).bitwiseAND(below))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, doc_id, leaf, ...) with ``at``, the place of their leaf in their tree."""
    some = rows.filter("doc_id is not null")
    maps = written(bitmaps(some.select("tree", "doc_id")), "manifest-bitmaps")
    ranks = written(directory(maps), "manifest-directory")
    keyed = ranks.select(F.struct("tree", "container").alias("_key"), "places", "bits", "before")
    keyed = F.broadcast(keyed) if ranks.count() <= FEW_CONTAINERS else keyed
    out = some.join(keyed, F.struct("tree", F.shiftright("doc_id", 16).alias("container")) == F.col("_key"))
    out = out.select(*rows.columns, rank(F.col("doc_id"), F.col("places"), F.col("bits"), F.col("before")).alias("at"))
    nulls = rows.filter("doc_id is null")
    word = F.explode(F.filter("words", lambda w: w["rows"] > F.bit_count(w["bits"]))).alias("w")
    full = written(maps.select("tree", F.col("container"), word).select("tree", (F.shiftleft("container", 10) + F.col("w.place")).alias("word")), "manifest-repeats")
    if full.isEmpty() and nulls.isEmpty():
        return out
    return _with_repeats(rows, out, full)


def _with_repeats(rows: DataFrame, out: DataFrame, full: DataFrame) -> DataFrame:
    """Places where ids are null or repeat: ``full`` names the words of 64 ids that have more rows than ids."""
    word = F.shiftright("doc_id", 6).alias("word")
    inside = out.withColumn("word", word)
    marked = broadcast_if_small(full)
    alone = inside.join(marked, ["tree", "word"], "left_anti").drop("word")
    # In such words, and among null ids, rows are numbered by id and leaf; a number of the row itself splits equal rows between tasks.
    again = inside.join(marked, ["tree", "word"], "left_semi")
    again = again.unionByName(rows.filter("doc_id is null").withColumn("word", F.lit(None).cast("bigint")).withColumn("at", F.lit(0).cast("bigint")))
    again = written(again.withColumn("_seq", F.monotonically_increasing_id()), "manifest-again")
    numbered = written(dense_numbers(again, ["tree", "word", "doc_id", "leaf", "_seq"], "_n"), "manifest-numbered")
    first = numbered.groupBy("tree", "word").agg(F.min("_n").alias("_first"), F.min("at").alias("_from"))
    first = broadcast_if_small(written(first.toDF("_tree", "_word", "_first", "_from"), "manifest-firsts"))
    numbered = numbered.join(first, F.col("tree").eqNullSafe(F.col("_tree")) & F.col("word").eqNullSafe(F.col("_word")))
    numbered = numbered.select(*rows.columns, (F.col("_from") + F.col("_n") - F.col("_first")).alias("at"))
    nulls = rows.filter("doc_id is null").groupBy("tree").agg(F.count(F.lit(1)).alias("_nulls"))
    moved = alone.unionByName(numbered).join(broadcast_if_small(written(nulls, "manifest-nulls")), "tree", "left")
    return moved.withColumn("at", F.col("at") + F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("_nulls", F.lit(0)))).drop("_nulls")


def heights(sizes: DataFrame) -> DataFrame:
    """(tree, height) of (tree, n): levels until one node is left."""
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.lit(0).alias("h"), F.col("n").cast("bigint").alias("n")), lambda a, _: F.when(a["n"] > 1, F.struct((a["h"] + 1).alias("h"), F.ceil(a["n"] / WAYS).alias("n"))).otherwise(a))
    return sizes.select("tree", steps["h"].alias("height"))


def _reduce(nodes: Column) -> Column:
    """One level: digests of runs of ``WAYS`` nodes."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / WAYS).cast("int") - 1)
    return F.transform(runs, lambda i: sha(F.array_join(F.slice(nodes, i * WAYS + 1, WAYS), "")))


def grouped(nodes: DataFrame, height: DataFrame, done: int, name: str) -> DataFrame:
    """(tree, block, height, slots, levels): groups of slots of ``nodes`` (tree, at, leaf, ...), and the nodes of each level of a group.

    ``done`` levels are below. A level above the tree's root repeats the one below it.
    """
    rest = [c for c in nodes.columns if c not in ("tree", "at")]
    block = nodes.groupBy("tree", F.floor(F.col("at") / SLOTS).cast("bigint").alias("block")).agg(F.array_sort(F.collect_list(F.struct((F.col("at") % SLOTS).cast("int").alias("slot"), *rest))).alias("slots"))
    block = block.join(broadcast_if_small(height), "tree")
    up = lambda made, k: F.concat(made, F.array(F.when(F.col("height") > done + k, _reduce(F.get(made, k))).otherwise(F.get(made, k))))
    levels = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), F.array(F.col("slots.leaf")), up)
    return written(block.select("tree", "block", "height", "slots", levels.alias("levels")), name)


def _top() -> Column:
    """The one node of a group's last level."""
    return F.get(F.get("levels", F.lit(LEVELS)), F.lit(0))


def trees(nodes: DataFrame, name: str) -> list[DataFrame]:
    """Rounds of groups of ``nodes`` (tree, at, leaf, ...), from the leaves to one group a tree."""
    sizes = written(nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), f"{name}-sizes")
    height = written(heights(sizes), f"{name}-heights")
    tallest = height.agg(F.max("height")).first()[0] or 0
    rounds, done = [grouped(nodes, height, 0, f"{name}-0")], LEVELS
    while done < tallest:
        above = rounds[-1].select("tree", F.col("block").alias("at"), _top().alias("leaf"))
        # A tree that has one node already has nothing above.
        above = above.join(broadcast_if_small(height.filter(F.col("height") > done)), "tree", "left_semi")
        rounds.append(grouped(above, height, done, f"{name}-{len(rounds)}"))
        done += LEVELS
    return rounds


def tops(rounds: list[DataFrame]) -> DataFrame:
    """(tree, root) of rounds of groups."""
    out = None
    for k, r in enumerate(rounds):
        found = r.filter(F.col("height") <= (k + 1) * LEVELS).select("tree", _top().alias("root"))
        out = found if out is None else out.union(found)
    return out


def _path(slot: Column, done: int) -> Column:
    """For each level of a group, below the tree's root: the siblings before and after the node over ``slot``."""
    steps = []
    for k in range(LEVELS):
        at = F.floor(slot / WAYS**k).cast("int")
        run = F.slice(F.get("levels", F.lit(k)), (at - at % WAYS + 1).cast("int"), WAYS)
        before, after = F.slice(run, 1, at % WAYS), F.slice(run, at % WAYS + 2, WAYS)
        steps.append(F.when(F.col("height") > done + k, F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def paths(rounds: list[DataFrame], above: DataFrame, name: str) -> DataFrame:
    """The leaves' rows with ``tree``, ``at`` and ``path``; ``above`` has (tree, path) from a tree's root on."""
    down = None
    for k in range(len(rounds) - 1, -1, -1):
        here = rounds[k].filter(F.col("height") <= (k + 1) * LEVELS).join(broadcast_if_small(above, FEW_PATHS), "tree")
        if down is not None:
            here = here.unionByName(rounds[k].filter(F.col("height") > (k + 1) * LEVELS).join(down, ["tree", "block"]).select(*here.columns))
        each = here.select("tree", F.col("block").alias("of"), F.explode(_handed(F.col("path"), k * LEVELS)).alias("x"))
        at = F.col("of") * SLOTS + F.col("x.node.slot")
        if not k:
            return each.select("tree", at.alias("at"), "x.node.*", "x.path")
        down = written(each.select("tree", at.alias("block"), "x.path"), f"{name}-paths-{k}")


def _handed(path: Column, done: int) -> Column:
    """Each slot of a group with its path to the root."""
    return F.transform("slots", lambda s: F.struct(s.alias("node"), F.concat(_path(s["slot"], done), path).alias("path")))


def fold(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda node, s: sha(F.concat(s["before"], node, s["after"])))


_STEP = "array<struct<before:string,after:string>>"


def manifest(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified."""
    found = written(leaves(docs), "manifest-leaves")
    sources = written(dense_numbers(found.select("source").distinct(), ["source"], "tree").withColumnRenamed("source", "_source"), "manifest-sources")
    marked = broadcast_if_small(sources)
    if marked is not sources:
        rows = found.join(marked, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    else:
        rows = join_by_key(found.withColumn("_name", F.struct("source")), sources.select(F.struct("_source").alias("_name"), "tree"), "_name").drop("_name")
    rounds = trees(placed(written(rows, "manifest-rows")), "manifest-tree")
    subroots = written(tops(rounds), "manifest-subroots")
    over = trees(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("at"), F.col("root").alias("leaf")), "manifest-top")
    root = written(tops(over).select("tree", "root"), "manifest-root")
    start = root.select("tree", F.array().cast(_STEP).alias("path"))
    of_source = written(paths(over, start, "manifest-top").select(F.col("at").alias("tree"), "path"), "manifest-source-paths")
    out = paths(rounds, of_source, "manifest-tree").join(F.broadcast(root.select("root")))  # one row
    out = out.join(broadcast_if_small(subroots.withColumnRenamed("root", "subroot")), "tree")
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = out.withColumn("folded_root", fold(F.coalesce("presented", "leaf"), F.col("path")))
    return out.select("doc_id", "source", "leaf", "subroot", "root", sha(proof).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
