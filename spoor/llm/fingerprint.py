"""Document fingerprints from prefix polynomial hashes.

A text's modular prefix arrays, two bases modulo 2^31 - 1, answer the equality
of any two spans, of one or of two texts, and binary search over them gives
longest common extensions. A fingerprint keeps the hash of the whole text and
the prefix and suffix hashes at up to 32 places, multiples of a power of two,
so fingerprints of different lengths share places. The likeness of two
fingerprints is the part of the longer text that their common prefix and common
suffix cover, each found by binary search over the shared places.

The next document of each is found without a global order in one task: rows are
dealt to key ranges, the first rows of a range also go to the range before, and
each range is read in order once, keeping one row back.

Defined results: null text counts as empty; all empty texts have one
fingerprint and are alike by 1, an empty and another text by 0; null ids come
last; rows with one id follow each other by text; a single document is its own
next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

MODULUS = (1 << 31) - 1
BASES = (1_000_003 * 911 % MODULUS, 1_000_033 * 577 % MODULUS)
PLACES = 32
_PIECE = 1 << 16


def _part(x: np.ndarray) -> np.ndarray:
    """A number below 2^33 that is x modulo 2^31 - 1, for x below 2^63 (2^32 + 2^31)."""
    return (x & np.uint64(MODULUS)) + (x >> np.uint64(31))


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1 for x below 2^63."""
    x = _part(_part(x))
    return np.where(x >= MODULUS, x - np.uint64(MODULUS), x)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _fold(out * np.uint64(pow(base, len(out), MODULUS)))])
    return out[:n]


_UP = np.array([_powers(b, _PIECE) for b in BASES])
_INVERSE = [pow(b, -1, MODULUS) for b in BASES]
_DOWN = np.array([_powers(b, _PIECE) for b in _INVERSE])


def _inverse_powers(at: np.ndarray) -> np.ndarray:
    """Both bases to the power -at."""
    low = _DOWN[:, at % _PIECE]
    if at.max() < _PIECE:
        return low
    return _fold(low * np.array([[pow(b, int(h) * _PIECE, MODULUS) for h in at // _PIECE] for b in _INVERSE], np.uint64))


def prefix_hashes(text: str) -> np.ndarray:
    """Shape (2, n + 1): entry i is congruent to the sum of (code + 1) * base^j over j < i modulo 2^31 - 1, and below 2^34."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    wide = len(codes) and codes.max() >= 1 << 16
    out = np.zeros((2, len(codes) + 1), np.uint64)
    for start in range(0, len(codes), _PIECE):
        terms = codes[start : start + _PIECE] * _UP[:, : len(codes) - start]
        sums = _part(np.cumsum(_fold(terms) if wide else terms, axis=1))  # 2^16 terms below 2^47
        if start:
            shift = np.array([[pow(b, start, MODULUS)] for b in BASES], np.uint64)
            sums = _part(_part(_part(sums) * shift)) + _fold(out[:, start : start + 1])
        out[:, start + 1 : start + 1 + sums.shape[1]] = sums
    return out


def span_hashes(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """62-bit hashes of the spans [start, stop), whatever stands before them."""
    start, stop = np.atleast_1d(start), np.atleast_1d(stop)
    spans = _fold(h[:, stop] + np.uint64(MODULUS) - _fold(h[:, start]))
    parts = _fold(spans * _inverse_powers(start))
    return parts[0] << np.uint64(31) | parts[1]


def equal_spans(h1: np.ndarray, a: int, h2: np.ndarray, b: int, length: int) -> bool:
    return bool(span_hashes(h1, a, a + length)[0] == span_hashes(h2, b, b + length)[0])


def common_extension(h1: np.ndarray, a: int, h2: np.ndarray, b: int) -> int:
    """How far the texts agree from position ``a`` of one and ``b`` of the other."""
    low, high = 0, min(h1.shape[1] - 1 - a, h2.shape[1] - 1 - b)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if equal_spans(h1, a, h2, b, middle) else (low, middle - 1)
    return low


def fingerprint(text: str) -> str:
    """``length.step.whole.prefixes.suffixes`` in hexadecimal; 32 bits for each prefix and suffix."""
    h = prefix_hashes(text)
    n = h.shape[1] - 1
    step = 1
    while n > PLACES * step:
        step *= 2
    at = np.arange(step, n + 1, step)
    whole, ends, starts = np.array([n]), at, n - at
    spans = span_hashes(h, np.concatenate([np.zeros(1 + len(at), np.int64), starts]), np.concatenate([whole, ends, np.full(len(at), n)]))
    low = ((spans >> np.uint64(31)) * np.uint64(0x9E3779B1) + spans).astype(np.uint32).astype(">u4").tobytes().hex()
    cut = 8 + 8 * len(at)
    return f"{n:x}.{step:x}.{int(spans[0]):016x}.{low[8:cut]}.{low[cut:]}"


def _agree(one: str, step1: int, two: str, step2: int, places: int, step: int) -> int:
    low, high = 0, places
    while low < high:
        middle = (low + high + 1) // 2
        i, j = 8 * (middle * step // step1), 8 * (middle * step // step2)
        low, high = (middle, high) if one[i - 8 : i] == two[j - 8 : j] else (low, middle - 1)
    return low * step


def likeness(one: str, two: str) -> float:
    """0 to 1, from two fingerprints alone."""
    if one == two:
        return 1.0
    (n1, s1, _, p1, q1), (n2, s2, _, p2, q2) = one.split("."), two.split(".")
    n1, n2, s1, s2 = int(n1, 16), int(n2, 16), int(s1, 16), int(s2, 16)
    step, short = max(s1, s2), min(n1, n2)
    both = _agree(p1, s1, p2, s2, short // step, step) + _agree(q1, s1, q2, s2, short // step, step)
    return min(both, short) / max(n1, n2)


def _ranges(docs: DataFrame, partitions: int) -> DataFrame:
    """Rows with ``range`` (0 has the largest ids) and ``guard``: rows that only stand after a range's last one."""
    known = docs.select("doc_id").filter("doc_id is not null")
    shares = [i / partitions for i in range(1, partitions)]
    cuts = known.agg(F.percentile_approx("doc_id", shares, 100 * partitions).alias("c")).first()["c"] if shares else []
    cuts = sorted(set(cuts or []), reverse=True)  # one number a partition
    width = max(1, ceil(sqrt(len(cuts))))
    above = lambda places: F.size(F.filter(places, lambda c: F.coalesce(F.col("doc_id") < c, F.lit(True))))
    if cuts:
        every = F.array(*[F.lit(c) for c in cuts])
        coarse = F.array(*[F.lit(c) for c in cuts[width - 1 :: width]])  # the last of each full run of cuts
        docs = docs.withColumn("run", above(coarse) * width)
        docs = docs.withColumn("range", F.col("run") + above(F.slice(every, F.col("run") + 1, F.lit(width)))).drop("run")
    else:
        docs = docs.withColumn("range", F.lit(0))
    firsts = {r["range"]: r["first"] for r in docs.groupBy("range").agg(F.max("doc_id").alias("first")).collect()}
    there = sorted(firsts)
    before = {r: there[i - 1] for i, r in enumerate(there)}
    size = len(cuts) + 1
    first_of = F.array(*[F.lit(firsts.get(r)).cast("bigint") for r in range(size)])
    goes_to = F.array(*[F.lit(before.get(r, 0)) for r in range(size)])
    is_first = F.col("doc_id").eqNullSafe(first_of[F.col("range")])
    places = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("guard")), F.struct(goes_to[F.col("range")].alias("range"), F.lit(True).alias("guard")))
    return docs.withColumn("place", F.explode(F.when(is_first, places).otherwise(F.slice(places, 1, 1)))).select("doc_id", "text", F.col("place.range").alias("range"), F.col("place.guard").alias("guard"))


_OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None  # the row whose next one has not come: id, text, fingerprint, range
    for batch in batches:
        out: list[tuple] = []
        for doc_id, text, where, guard in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "guard"))):
            same = held is not None and held[3] == where
            if guard and not same:
                continue  # a second guard
            own = fingerprint(text)
            if same:
                n = len(held[1])
                edited = held[1][: n - n // 3] + text[: n // 3]
                changed = fingerprint(edited)
                out.append((held[0], n, hashlib.sha256(edited.encode()).hexdigest(), held[2], changed, likeness(held[2], changed), likeness(held[2], own)))
            held = None if guard else (doc_id, text, own, where)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _OUT.split(", ")])


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text (its last third replaced by the start of the next document's)."""
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _ranges(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")), partitions)
    dealt = rows.repartitionById(partitions, F.col("range")).sortWithinPartitions("range", "guard", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return dealt.mapInArrow(_edit, _OUT)
