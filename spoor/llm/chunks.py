"""Substring deduplication by content-defined chunking with a gear rolling hash.

Cuts. The gear hash h = 2h + G[byte] modulo 2^16 sees the last ``GRAM`` bytes. A
place is a cut if its hash is the least (the first of equal ones) of some
window of ``WINDOW`` places of its text. Word beginnings go before other
places, and no cut is inside a character. So cuts depend on nearby bytes alone:
an insertion moves them, but does not change which there are. In a stretch that
repeats itself every few bytes only every so many equal cuts stay. The
beginning and the end of a text are cuts too.

Chunks. A chunk goes from a cut to the first cut at least ``MIN_BYTES`` further
on, and the last one from the last such cut to the end; chunks overlap, so that
it does not matter where a passage begins. They are deduplicated by digest: a
chunk that another row has too is repeated, and chunks that touch form a span.
What is flagged is therefore always ``MIN_BYTES`` or more that one other row
has in one piece. A passage of ``GRAM + 2 * WINDOW + MIN_BYTES`` bytes or more
is always found, less up to ``GRAM + WINDOW`` bytes at its beginning and twice
``WINDOW`` at its end (``WINDOW`` more at both where a few bytes repeat);
shorter ones of ``MIN_BYTES`` or more are found if cuts permit.

The row with the least doc_id keeps a chunk (null ids last; of one id the row
read first), the others lose it. Rows are told apart by numbers of our own,
never by doc_id, so rows that share an id or have none lose their own repeats only.

Defined results: null text counts as empty; what repeats only within one row
stays; of repeated rows one keeps its text; an empty table gives no rows.
Digests have 64 bits and bytes are not compared: among 10^12 chunks about
3 * 10^4 pairs of different ones meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, packed, text_of, unpacked, written

#: Bytes that the gear hash sees, places of a window, and the least bytes of a chunk: about 50 words with what the edges may lose.
GRAM, WINDOW, MIN_BYTES = 16, 40, 200
#: Bytes that are hashed at once.
PIECE = 1 << 20
#: Orders null ids last.
_LAST = (1 << 63) - 1

GEAR = np.random.default_rng(2024).integers(0, 1 << 16, 256, dtype=np.uint16)
_TABLE = np.random.default_rng(2026).integers(0, 1 << 64, 256, dtype=np.uint64)
_BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BASE = 0x5851F42D4C957F2D


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_UP, _DOWN = _powers(_BASE, PIECE), _powers(pow(_BASE, -1, 1 << 64), PIECE)


def _lowest(b: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts by windows in the joined texts ``b``, and their order keys; no window reaches from one text into another."""
    windows = np.maximum(0, sizes - GRAM - WINDOW + 1)
    if not windows.any():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = GEAR[b]
    for span in (1, 2, 4, 8):  # the hash over the last 2 * span bytes from that over span bytes
        h[span:] = h[span:] + (h[:-span] << np.uint16(span))
    blank = _BLANK[b]
    key = h[:-1].astype(np.uint64)  # of the place before byte i + 1
    key |= np.where(blank[:-1] & ~blank[1:], np.uint64(0), np.uint64(1 << 16))
    key |= np.where((b[1:] & 0xC0) == 0x80, np.uint64(1 << 17), np.uint64(0))
    key = (key << np.uint64(40)) | np.arange(1, len(b), dtype=np.uint64)
    least = key
    for span in (1, 2, 4, 8, 16, WINDOW - 32):
        least = np.minimum(least[:-span], least[span:])
    first = np.repeat(begin + GRAM - 1 - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    found = least[first]
    found = found[np.concatenate([[True], found[1:] != found[:-1]])]
    return (found & np.uint64((1 << 40) - 1)).astype(np.int64), found >> np.uint64(40)


def _thinned(at: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of cuts with equal hashes at equal small distances, as a repeated word gives, the first and then one in every window."""
    gap = np.diff(at, prepend=-GRAM - 1)
    same = np.concatenate([[False], key[1:] == key[:-1]]) & (gap <= GRAM)
    same[1:] &= ~same[:-1] | (gap[1:] == gap[:-1])
    index = np.arange(len(at))
    rank = index - np.maximum.accumulate(np.where(same, 0, index))
    return at[rank % np.maximum(1, WINDOW // gap) == 0]


def cuts(texts: list[bytes]) -> list[np.ndarray]:
    """The cuts of each text, from 0 to its length."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if len(texts) == 1 and sizes[0] > PIECE:
        parts = [_lowest(np.frombuffer(texts[0], np.uint8, min(PIECE + GRAM + WINDOW - 1, sizes[0] - o), o), np.zeros(1, np.int64), np.array([min(PIECE + GRAM + WINDOW - 1, sizes[0] - o)])) for o in range(0, sizes[0], PIECE)]
        at = np.concatenate([a + o for (a, _), o in zip(parts, range(0, sizes[0], PIECE))])
        key = np.concatenate([k for _, k in parts])
        new = np.diff(at, prepend=-1) > 0
        at, key = at[new], key[new]
    else:
        at, key = _lowest(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)
    ends = np.cumsum(sizes)
    out = []
    for begin, end, i, k in zip(ends - sizes, ends, np.searchsorted(at, ends - sizes), np.searchsorted(at, ends)):
        here = _thinned(at[i:k] - begin, key[i:k]) if k > i else at[i:k]
        out.append(np.concatenate([[0], here, [end - begin]]))
    return out


def _hashes(data: bytes, places: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2^64 of the bytes before each of the ascending ``places``."""
    out, before, scale = np.empty(len(places), np.uint64), 0, 1
    for o in range(0, max(1, len(data)), PIECE):
        b = np.frombuffer(data, np.uint8, min(PIECE, len(data) - o), o)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[b] * _UP[: len(b)])])
        i, k = np.searchsorted(places, [o, o + len(b) + 1])
        out[i:k] = np.uint64(before) + np.uint64(scale) * sums[places[i:k] - o]
        before = (before + scale * int(sums[-1])) % (1 << 64)
        scale = scale * pow(_BASE, len(b), 1 << 64) % (1 << 64)
    return out


def _shift_back(places: np.ndarray) -> np.ndarray:
    """The base to the power of minus each place."""
    rounds, rest = np.divmod(places, PIECE)
    back = pow(_BASE, -PIECE, 1 << 64)
    return _DOWN[rest] * np.array([pow(back, k, 1 << 64) for k in range(int(rounds.max(initial=0)) + 1)], np.uint64)[rounds]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def chunk_spans(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first and last cut of each chunk."""
    size = places[-1]
    first = np.flatnonzero(places + MIN_BYTES <= size)
    last = np.searchsorted(places, places[first] + MIN_BYTES)
    if len(first) and last[-1] < len(places) - 1:
        first, last = np.append(first, first[-1]), np.append(last, len(places) - 1)
    return first, last


def chunks(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, digest) of the chunks of each text, as arrays."""
    found = cuts(texts)
    data, out = b"".join(texts), []
    begin = np.cumsum([0, *map(len, texts)])
    every = np.concatenate([p + o for p, o in zip(found, begin)])
    sums, back = _hashes(data, every), _shift_back(every)
    row = 0
    for places in found:
        h, d = sums[row : row + len(places)], back[row : row + len(places)]
        row += len(places)
        first, last = chunk_spans(places)
        digest = _mixed((h[last] - h[first]) * d[first] + (places[last] - places[first]).astype(np.uint64))
        out.append((places[first], places[last], digest))
    return out


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(some, texts):
        start, end, digest = zip(*chunks(texts))
        arrays = [pa.array(list(column), pa.list_(pa.int64())) for column in (digest, start, [e - s for s, e in zip(start, end)])]
        picked = batch.take(pa.array(some))
        return pa.RecordBatch.from_arrays([picked.column(0), picked.column(1), *arrays], ["row", "doc", "digests", "starts", "sizes"])

    for batch in batches:
        some, texts, size = [], [], 0
        for i in range(batch.num_rows):
            data = batch.column(2)[i].as_py().encode()
            if some and size + len(data) > PIECE:
                yield rows(some, texts)
                some, texts, size = [], [], 0
            some.append(i)
            texts.append(data)
            size += len(data)
        if some:
            yield rows(some, texts)


def chunk_table(rows: DataFrame) -> DataFrame:
    """One written row for each of ``rows`` (row, doc, text): row, doc, and its chunks' digests, starts and sizes."""
    return written(rows.mapInArrow(_chunk, "row bigint, doc bigint, digests array<bigint>, starts array<bigint>, sizes array<bigint>"), "chunks")


def repeated(table: DataFrame) -> DataFrame:
    """The repeated chunks in the rows of a chunk table: row, start, end, keeper (its doc), lost (whether this row loses it)."""
    told = table.select("row", "doc", F.explode("digests").alias("digest")).groupBy("digest")
    shared = told.agg(F.min("doc").alias("keeper"), F.min("row").alias("r"), F.max("row").alias("m")).filter("r < m").select(F.col("digest").alias("d"), "keeper")
    # Written, so that the join deals both sides anew and AQE may split a digest that very many rows have.
    shared = broadcast_if_small(written(shared, "chunks-shared"))
    each = table.select("row", "doc", F.explode(F.arrays_zip("digests", "starts", "sizes")).alias("c"))
    each = each.select("row", "doc", F.col("c.digests").alias("digest"), F.col("c.starts").alias("start"), (F.col("c.starts") + F.col("c.sizes")).alias("end"))
    hits = written(each.join(shared, F.col("digest") == F.col("d")).drop("d"), "chunk-hits")
    again = table.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc").alias("again"))
    lost = F.col("doc") != F.col("keeper")
    if (again := written(again, "chunk-ids")).isEmpty():
        return hits.withColumn("lost", lost)
    # Rows that share an id (or have none): of those with the keeper's id, the row read first keeps the chunk.
    owner = hits.filter(~lost).join(broadcast_if_small(again), F.col("doc") == F.col("again")).groupBy("digest").agg(F.min("row").alias("owner")).withColumnRenamed("digest", "d")
    return hits.join(broadcast_if_small(written(owner, "chunk-owners")), F.col("digest") == F.col("d"), "left").withColumn("lost", lost | F.coalesce(F.col("row") != F.col("owner"), F.lit(False)))


def _united(chunks: DataFrame) -> DataFrame:
    """Spans (array of start, end) of each row: its chunks, those that touch made one."""
    by_place = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.coalesce(F.col("start") > reach, F.lit(True)), 1).otherwise(0)
    numbered = chunks.select("row", "start", "end", new.alias("new")).withColumn("span", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("row", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _doc(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("bigint"), F.lit(_LAST))


def report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, repeated, n_spans, repeated_bytes, removed_bytes, spans as text (UTF-8 bytes), first_doc_ids (the documents that keep its chunks)."""
    table = chunk_table(docs.select(F.monotonically_increasing_id().alias("row"), _doc().alias("doc"), text_of().alias("text")))
    hits = written(repeated(table), "chunk-repeated")
    firsts = hits.groupBy("row", "keeper").agg(F.min("start").alias("start")).groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("keeper") < _LAST, F.col("keeper")))).alias("firsts"))
    spans = _united(hits).join(firsts, "row").join(_united(hits.filter("lost")).withColumnRenamed("spans", "gone"), "row", "left").withColumnRenamed("row", "r")
    length = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    zero = F.lit(0).cast("bigint")
    rows = table.select("row", "doc").join(written(spans, "chunk-spans"), F.col("row") == F.col("r"), "left")
    return rows.select(
        F.when(F.col("doc") < _LAST, F.col("doc")).alias("doc_id"), F.col("spans").isNotNull().alias("repeated"), F.coalesce(F.size("spans").cast("bigint"), zero).alias("n_spans"),
        F.coalesce(length(F.col("spans")), zero).alias("repeated_bytes"), F.coalesce(length(F.col("gone")), zero).alias("removed_bytes"),
        F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit("")).alias("spans"),
        F.coalesce("firsts", F.array().cast("array<bigint>")).alias("first_doc_ids"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the chunks cut out that other rows keep."""
    rows = written(packed(docs, _row=F.monotonically_increasing_id()), "chunk-docs")
    table = chunk_table(rows.select(F.col("_row").alias("row"), _doc("row.doc_id").alias("doc"), text_of("row.text").alias("text")))
    gone = _united(repeated(table).filter("lost")).select(F.col("row").alias("r"), F.col("spans").alias("gone"))

    @F.pandas_udf("string")
    def without(text: pd.Series, gone: pd.Series) -> pd.Series:
        def one(t, spans):
            if t is None or spans is None or not len(spans):
                return t
            data, out, at = t.encode(), [], 0
            for s in spans:
                out.append(data[at : s["start"]])
                at = s["end"]
            return b"".join([*out, data[at:]]).decode()

        return pd.Series([one(t, g) for t, g in zip(text, gone)])

    found = rows.join(written(gone, "chunk-gone"), F.col("_row") == F.col("r"), "left")
    return unpacked(found.withColumn("row", F.col("row").withField("text", without(F.col("row.text").cast("string"), F.col("gone")))), docs)
