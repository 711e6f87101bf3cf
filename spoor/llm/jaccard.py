"""N-gram Jaccard join with Bayesian candidate pruning over MinHash values.

Words are the lower-cased text between white space; a document's set is its
runs of five words (fewer words: one run of all of them, the empty text
included). Two documents are linked when the Jaccard similarity of their sets
is at least ``threshold``.

1. One pass turns each text into a digest of its words, its set (64-bit hashes)
   and ``N_HASHES`` MinHash values. Equal word sequences become one
   representative with a count, so copies are never paired with one another.
2. Bands of MinHash values give candidates (a pair at 0.8 shares none with
   probability about 5e-7). The least member of a band value is its root; the
   least root of a member is its home. A pair with one home is compared in that
   home's group, any other pair in the group of the root of its first shared
   band. A member is sent to its home and to the roots of the band values whose
   members differ in home, so groups are about one document's likes: long chains
   of likes make many small groups, not a large one.
3. A large group is cut into blocks by a hash of the member, and every pair of
   blocks of it is one task group: none grows with the group. In it, pairs that
   share a band are compared ``STEP`` MinHash values at a time and dropped as
   soon as the posterior probability of reaching the threshold falls below
   ``TOLERANCE``; the rest are verified exactly on the sets. The task group
   returns link counts for its members and a spanning forest of the links, not
   the pairs.
4. Components of the forests are the classes. A document's links are those of
   its representative, weighted by copies, plus its own copies.

Defined results: null text counts as empty; all empty texts are copies of one
another; repeated rows count as copies; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, packed, released, text_of, unpacked, written
from ..plans.components import connected_components, join_by_key

WORDS = 5
THRESHOLD = 0.8
N_HASHES = 180
BAND_ROWS = 5
STEP = 36
TOLERANCE = 1e-6
#: Stands for a null doc_id.
_NULL_ID = -(1 << 62)
#: Members and words of a block; a task group has at most about twice as many.
BLOCK, BLOCK_WORDS = 384, 2_000_000
_PLACES = "array<struct<target:bigint,low:int,high:int,block:int>>"

_MULTIPLIERS = np.random.default_rng(7).integers(1, 1 << 31, N_HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADDENDS = np.random.default_rng(8).integers(0, 1 << 32, N_HASHES, dtype=np.uint64).astype(np.uint32)
_MIX = [np.uint64(int(x)) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _WordIds(dict):
    """64-bit hashes of words, kept between documents up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[str], ids: _WordIds, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` words."""
    h = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    runs = max(1, len(h) - n + 1)
    out = np.full(runs, len(h) if len(h) < n else n, np.uint64)
    for k in range(min(n, len(h))):
        out = _mix(out * _MIX[0] + h[k : k + runs])
    return np.unique(out)


def minhash(hashes: np.ndarray) -> np.ndarray:
    """``N_HASHES`` MinHash values (32 bits) of a set, in bounded pieces."""
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    best = np.full(N_HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(folded), 1024):
        values = folded[i : i + 1024][None, :] * _MULTIPLIERS[:, None] + _ADDENDS[:, None]
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        values ^= values >> np.uint32(13)
        np.minimum(best, values.min(axis=1), out=best)
    return best


def band_values(signature: np.ndarray) -> np.ndarray:
    """One 64-bit value a band of the last axis; bands differ by a seed."""
    bands = signature.reshape(*signature.shape[:-1], N_HASHES // BAND_ROWS, BAND_ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(N_HASHES // BAND_ROWS, dtype=np.uint64), bands.shape[:-1]).copy()
    for k in range(BAND_ROWS):
        out = _mix(out * _MIX[0] + bands[..., k])
    return out


def _texts(batch: pa.RecordBatch, size: int = 512) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Slices of a batch with the words of their texts (the last column)."""
    for part in (batch.slice(i, size) for i in range(0, batch.num_rows, size)):
        yield part, [t.as_py().lower().split() for t in part.column(part.num_columns - 1)]


def _digest(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest("\0".join(words).encode())


def _digests(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _digest(t.lower().split()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = _WordIds()
    for batch in batches:
        for part, texts in _texts(batch):
            bands = band_values(np.array([minhash(shingle_set(w, ids)) for w in texts])).view(np.int64)
            columns = [*part.columns[:2], pa.array([_digest(w) for w in texts], pa.binary()), pa.array(list(bands), pa.list_(pa.int64())), pa.array([len(w) for w in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "digest", "bands", "words"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MinHash values and sets of the texts, beside their other columns."""
    ids = _WordIds()
    for batch in batches:
        for part, texts in _texts(batch):
            grams = [shingle_set(words, ids) for words in texts]
            made = [pa.array([minhash(g).tobytes() for g in grams], pa.binary()), pa.array([g.tobytes() for g in grams], pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*part.schema.names[:-1], "sig", "grams"])


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each number of compared values (multiples of ``STEP``), the fewest matches at which the posterior, from a uniform prior, of a similarity of at least ``threshold`` is not below ``tolerance``."""

    def reaches(m: int, n: int) -> float:  # P(Beta(m+1, n-m+1) >= t) = P(Binomial(n+1, t) <= m)
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return tuple(next(m for m in range(n + 1) if reaches(m, n) >= tolerance) for n in range(STEP, N_HASHES + 1, STEP))


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


@dataclass
class Members:
    """The rows of a task group as arrays: MinHash values, sets, homes, and each band's root."""

    sig: np.ndarray
    grams: list[np.ndarray]
    home: np.ndarray
    roots: np.ndarray


def linked_pairs(group: Members, left: np.ndarray, right: np.ndarray, target: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> Iterator[tuple[int, np.ndarray]]:
    """For each row number in ``left``: it and the numbers in ``right`` above it in order that are linked to it, of the pairs that are ``target``'s to compare."""
    sizes = np.array([len(g) for g in group.grams])
    sig, bands, least = group.sig, band_values(group.sig), least_matches(threshold, tolerance)
    for i in left:
        other = right if left is not right else right[right > i]
        low, high = np.minimum(sizes[i], sizes[other]), np.maximum(sizes[i], sizes[other])
        other = other[low >= threshold * high]  # no pair of such sizes can reach the threshold otherwise
        if len(other):
            shared = bands[other] == bands[i]
            ours = np.where(group.home[other] == group.home[i], group.home[i] == target, group.roots[i][shared.argmax(axis=1)] == target)
            other = other[shared.any(axis=1) & ours]
        matches = np.zeros(len(other), int)
        for k, needed in enumerate(least):
            if not len(other):
                break
            here = slice(k * STEP, (k + 1) * STEP)
            matches = matches + (sig[other, here] == sig[i, here]).sum(axis=1)
            stays = matches >= needed
            other, matches = other[stays], matches[stays]
        if len(other):
            yield i, other[[_jaccard(group.grams[i], group.grams[j]) >= threshold for j in other]]


def _block_pair(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Links within a block or between two blocks of a group: copies linked to each member, and a spanning forest."""
    target, low, high = key
    group = group.sort_values("node", ignore_index=True)
    node, copies, block = group["node"].to_numpy(), group["copies"].to_numpy(), group["block"].to_numpy()
    sig = np.frombuffer(b"".join(group["sig"]), np.uint32).reshape(-1, N_HASHES)
    members = Members(sig, [np.frombuffer(g, np.uint64) for g in group["grams"]], group["home"].to_numpy(), np.array(group["roots"].tolist()))
    left = np.flatnonzero(block == low)
    right = left if low == high else np.flatnonzero(block == high)
    links, parent = np.zeros(len(node), np.int64), np.arange(len(node))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, others in linked_pairs(members, left, right, target):
        if len(others):
            links[i] += copies[others].sum()
            links[others] += copies[i]
            for r in {root(j) for j in others} | {root(i)}:
                a, b = sorted((root(i), r))
                parent[b] = a
    return pd.DataFrame({"node": node, "links": links, "linked_to": node[[root(i) for i in range(len(node))]]})[links > 0]


def _placed(groups: DataFrame) -> DataFrame:
    """One row for each member of a shared band value: node, home, roots by band (-1 where it shares none), places (target, low, high, block)."""
    bands = groups.select("node", F.posexplode("bands").alias("k", "band"))
    roots = bands.groupBy("band").agg(F.min("node").alias("root"), F.max("node").alias("last")).filter("root < last").drop("last")
    shared = written(join_by_key(bands, roots, "band"), "jaccard-shared")
    shared = written(join_by_key(shared, shared.groupBy("node").agg(F.min("root").alias("home")), "node"), "jaccard-homes")
    mixed = shared.groupBy("band").agg((F.min("home") < F.max("home")).alias("mixed"))
    shared = join_by_key(shared, mixed, "band")
    by_band = F.map_from_entries(F.collect_list(F.struct("k", "root")))
    members = shared.groupBy("node").agg(F.first("home").alias("home"), by_band.alias("by_band"), F.collect_set(F.when(F.col("mixed"), F.col("root"))).alias("more"))
    root = F.transform(F.sequence(F.lit(0), F.lit(N_HASHES // BAND_ROWS - 1)), lambda k: F.coalesce(F.col("by_band")[k], F.lit(-1).cast("bigint")))
    members = written(members.select("node", "home", root.alias("roots"), F.array_union(F.array("home"), "more").alias("targets")).join(groups.select("node", "words"), "node"), "jaccard-members")

    each = members.select("node", "words", F.explode("targets").alias("target"))
    blocks = each.groupBy("target").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("words") / BLOCK_WORDS)).cast("int").alias("blocks"))
    each = join_by_key(each, blocks, "target").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct("target", F.least("block", b).alias("low"), F.greatest("block", b).alias("high"), "block"))
    places = each.groupBy("node").agg(F.flatten(F.collect_list(pairs)).alias("places"))
    return members.select("node", "home", "roots").join(places, "node")


def classes(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, digest, rep (the least id of its copies), copies, class_id (the least id of its class), links."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64(text_of()).alias("version"), text_of().alias("text"))
    signed = written(texts.mapInArrow(released(_sign), "doc_id bigint, version bigint, digest binary, bands array<bigint>, words bigint"), "jaccard-signed")
    groups = signed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("version", "doc_id").alias("version"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.max("words").alias("words"))
    groups = written(groups.withColumn("node", F.monotonically_increasing_id()), "jaccard-groups")

    placed = written(_placed(groups).join(groups.select("node", "rep", F.col("version").alias("v"), "copies"), "node"), "jaccard-placed")
    same = (F.col("rep") == F.col("doc_id")) & (F.col("v") == F.col("version"))
    # Rows with one id and one text have one representative: one of the texts is enough.
    members = texts.join(broadcast_if_small(placed.select("node", "rep", "v")), same).groupBy("node").agg(F.first("text").alias("text"))
    members = join_by_key(placed.drop("rep", "v"), members, "node").select("node", "copies", "home", "roots", "places", "text")
    members = members.mapInArrow(released(_sets), f"node bigint, copies bigint, home bigint, roots array<bigint>, places {_PLACES}, sig binary, grams binary")
    members = members.withColumn("place", F.explode("places")).select("node", "copies", "home", "roots", "sig", "grams", "place.*")
    found = written(members.groupBy("target", "low", "high").applyInPandas(_block_pair, "node bigint, links bigint, linked_to bigint"), "jaccard-links")

    forest = found.filter("node <> linked_to").select(F.col("node").alias("a"), F.col("linked_to").alias("b")).distinct()
    joined = connected_components(written(forest, "jaccard-forest"), lambda df, k: written(df, f"jaccard-classes-{k}")).join(groups.select("node", "rep"), "node")
    named = joined.join(joined.groupBy("component").agg(F.min("rep").alias("class_id")), "component").select("node", "class_id")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    told = groups.drop("bands", "words", "version").join(named, "node", "left").join(links, "node", "left")
    told = told.select("digest", "rep", "copies", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    as_id = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c)).alias(c)
    return signed.select("doc_id", "digest").join(told, "digest").select(as_id("doc_id"), "digest", as_id("rep"), "copies", as_id("class_id"), "links")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each class stays, the one with the least doc_id, with all its columns."""
    found = written(classes(docs).select("doc_id", "digest", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("stays")), "jaccard-classes-of")
    ids = found.groupBy("doc_id").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("times"))
    gone = written(ids.filter("not stays or times > 1").withColumnRenamed("doc_id", "sid"), "jaccard-gone")
    rows = packed(docs, rid=F.col("doc_id").cast("bigint"), rtext=text_of())
    same = F.col("rid").eqNullSafe(F.col("sid"))
    out = rows.join(broadcast_if_small(gone), same, "left_anti")
    if not (repeated := gone.filter("stays")).isEmpty():
        # Rows that share an id: one of each sequence of words that stays.
        digests = F.pandas_udf(_digests, "binary")
        kept = found.filter("stays").select(F.col("doc_id").alias("kid"), F.col("digest").alias("kdigest"))
        shared = rows.join(repeated, same, "left_semi").withColumn("rdigest", digests("rtext"))
        shared = shared.join(kept, F.col("rid").eqNullSafe(F.col("kid")) & (F.col("rdigest") == F.col("kdigest")), "left_semi")
        out = out.unionByName(shared.dropDuplicates(["rid", "rdigest"]).drop("rdigest"))
    return unpacked(out, docs)
