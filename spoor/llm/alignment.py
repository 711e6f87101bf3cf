"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Tokenizer A is a byte-level BPE (a ``tokenizers`` JSON file), B a sentencepiece
model with byte fallback. Both see the text behind one space: A gets it written,
B adds it. A byte offset where a token of A and a token of B both end is a cut;
the tokens between neighbouring cuts are a group, and every token of A in a
group is linked to every token of B in it.

1. ``shared_cuts`` finds the groups of many texts at once: in every open
   interval a common end near the middle is looked for by bisecting the ends of
   both; where there is one, both halves are open intervals of the next round,
   and an interval without a common end inside is a group. So a text of n groups
   takes about log n rounds, whose steps are array operations.
2. Texts go through the tokenizers whole, a bounded number of characters (or one
   text) at a time. A group yields each pair of its distinct ids once, with a
   number.
3. The rows are written with their distinct linked id pairs and how often each
   occurs. Counting a pair's documents and an A id's best pair are groupings of
   that table; the counts go back to the documents by a join on the pair, which
   is a broadcast only if the pairs are counted to be few.

Defined results: null and empty texts, and texts that either tokenizer does not
give back byte by byte, have no tokens: zeros and ''. Repeated rows count as
documents of their own; null ids stay null; an empty table gives no rows; other
columns of the input are not looked at. A long group without cuts costs the
product of its distinct ids, not of its tokens.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import join_by_key
from .common import broadcast_if_small, released, text_of, written

#: Characters of the texts that are aligned together, and links of a group that are written out before they are counted.
TOGETHER, MOST_LINKS = 250_000, 4096
#: Pairs that a join may broadcast: about 100 MB on each executor.
FEW_PAIRS = 1_000_000
#: The pattern that byte-level files without one of their own stand for (a fixed value).
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def shared_cuts(a: np.ndarray, b: np.ndarray, first: np.ndarray, i0: np.ndarray, i1: np.ndarray, j0: np.ndarray, j1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends (numbers in ``a`` and in ``b``) of all groups in order.

    ``a`` and ``b`` are rising ends of tokens. Interval k has the tokens i0[k] to
    i1[k] of A and j0[k] to j1[k] of B; it begins at the offset first[k], and its
    last tokens end together.
    """
    found_i, found_j = [], []
    while len(i0):
        # Looked for where both have two tokens or more.
        many = (i1 - i0 > 1) & (j1 - j0 > 1)
        found_i.append(i1[~many])
        found_j.append(j1[~many])
        first, i0, i1, j0, j1 = first[many], i0[many], i1[many], j0[many], j1[many]
        cut_i, cut_j = _near_middle(a, b, first, i0, i1, j0, j1)
        none = cut_i < 0
        found_i.append(i1[none])
        found_j.append(j1[none])
        first, i0, i1, j0, j1, cut_i, cut_j = (x[~none] for x in (first, i0, i1, j0, j1, cut_i, cut_j))
        first = np.concatenate([first, a[cut_i - 1]])
        i0, i1 = np.concatenate([i0, cut_i]), np.concatenate([cut_i, i1])
        j0, j1 = np.concatenate([j0, cut_j]), np.concatenate([cut_j, j1])
    ends_i, ends_j = np.concatenate([np.zeros(0, np.int64), *found_i]), np.concatenate([np.zeros(0, np.int64), *found_j])
    order = np.argsort(ends_i)
    return ends_i[order], ends_j[order]


#: Tokens to each side of the middle that are tried for all intervals at once; what is left is tried interval by interval.
_STEPS = 8


def _near_middle(a: np.ndarray, b: np.ndarray, first: np.ndarray, i0: np.ndarray, i1: np.ndarray, j0: np.ndarray, j1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval how many tokens of A and of B end at or before a common end near its middle; -1 if there is none inside."""
    middle = (first + a[i1 - 1]) // 2
    at = np.clip(np.searchsorted(a, middle), i0, i1 - 2)
    cut_i, cut_j = np.full(len(i0), -1), np.full(len(i0), -1)
    open_ = np.arange(len(i0))
    for step in range(2 * _STEPS):
        tried = at[open_] + (step // 2 if step % 2 == 0 else -1 - step // 2)
        inside = (tried >= i0[open_]) & (tried < i1[open_] - 1)
        rows, tried = open_[inside], tried[inside]
        j = np.searchsorted(b, a[tried])
        same = b[j] == a[tried]
        cut_i[rows[same]], cut_j[rows[same]] = tried[same] + 1, j[same] + 1
        open_ = open_[cut_i[open_] < 0]
    for k in open_[(i1 - i0)[open_] > _STEPS].tolist():
        ends = a[i0[k] : i1[k] - 1]
        j = np.searchsorted(b[: j1[k]], ends)
        same = np.flatnonzero(b[j] == ends)
        if len(same):
            near = same[np.abs(ends[same] - middle[k]).argmin()]
            cut_i[k], cut_j[k] = i0[k] + near + 1, j[near] + 1
    return cut_i, cut_j


def _bytes_of_characters() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others, in order, for 256 and on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_level(json_file: str):
    """(encode, bytes of each id) of a byte-level BPE file.

    A plain one, whose merges make tokens in the order of their ids, is run by
    tiktoken, which gives the same ids several times faster; any other by the
    tokenizers library.
    """
    import tiktoken

    with open(json_file, encoding="utf-8") as text:
        told = json.load(text)
    vocabulary, special, byte = told["model"]["vocab"], {t["content"] for t in told["added_tokens"]}, _bytes_of_characters()
    spelled = {i: bytes(byte[c] for c in token) for token, i in vocabulary.items() if token not in special}
    merges = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in told["model"]["merges"]]
    before, model = told["pre_tokenizer"], told["model"]
    plain = (
        merges == sorted(merges) and len(set(merges)) == len(merges) == len(spelled) - 256 and told["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        and not before.get("add_prefix_space") and not model.get("dropout") and not model.get("ignore_merges") and all(len(spelled[i]) == 1 for i in set(spelled) - set(merges))
    )
    if plain:
        made = tiktoken.Encoding("spoor-a", pat_str=_BYTE_LEVEL, mergeable_ranks={b: i for i, b in spelled.items()}, special_tokens={})
        return lambda text: made.encode_to_numpy(text, disallowed_special=()), spelled
    return library_encode(json_file), spelled


def library_encode(json_file: str):
    from tokenizers import Tokenizer

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    tokenizer = Tokenizer.from_file(json_file)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class Aligner:
    """Both tokenizers of a worker, their ids' bytes, and the texts of ids in a group's line."""

    def __init__(self, json_file: str, model_file: str):
        import sentencepiece

        self.encode_a, spelled = byte_level(json_file)
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.encode_b = model.encode
        self.bytes_a = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]
        self.size_a, self.size_b = (np.array([len(x) for x in spelling]) for spelling in (self.bytes_a, self.bytes_b))
        self.ids = max(len(self.bytes_a), len(self.bytes_b))
        self.told = [f"{i}{after}" for after in ",|;" for i in range(self.ids)]

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Both tokenizers' ids; None if the text has no tokens."""
        if not text:
            return None
        a, b, raw = np.asarray(self.encode_a(" " + text), np.int64), np.array(self.encode_b(text), np.int64), b" " + text.encode()
        holds = all(b"".join(map(spelling.__getitem__, ids.tolist())) == raw for spelling, ids in ((self.bytes_a, a), (self.bytes_b, b)))
        return (a, b) if holds else None

    def texts(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """For each text (tokens of A, of B, groups, links, digest of the groups), and for all, in order: which text, linked id pair (A id << 32 | B id), its number."""
        both = [self.encoded(t) for t in texts]
        some = [k for k, x in enumerate(both) if x is not None]
        rows: list[tuple] = [(0, 0, 0, 0, "")] * len(texts)
        none = np.zeros(0, np.int64)
        if not some:
            return rows, none, none, none
        ids_a, ids_b = (np.concatenate([both[k][side] for k in some]) for side in (0, 1))
        upto_a, upto_b = (np.cumsum([0] + [len(both[k][side]) for k in some]) for side in (0, 1))
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        start = np.r_[0, ends_a[upto_a[1:-1] - 1]]
        i1, j1 = shared_cuts(ends_a, ends_b, start, upto_a[:-1], upto_a[1:], upto_b[:-1], upto_b[1:])
        n, m = np.diff(i1, prepend=0), np.diff(j1, prepend=0)
        of_text = np.searchsorted(upto_a, i1) - 1
        groups, links = np.bincount(of_text, minlength=len(some)), np.bincount(of_text, n * m, len(some)).astype(np.int64)
        # The line of a text: tokens by group, those of A first, each followed by its separator.
        group_a, group_b = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
        place_a, place_b = np.arange(len(ids_a)) + np.r_[0, j1[:-1]][group_a], np.arange(len(ids_b)) + i1[group_b]
        line = np.empty(len(ids_a) + len(ids_b), np.int64)
        line[place_a], line[place_b] = ids_a, ids_b
        line[place_a[i1 - 1]] += self.ids
        line[place_b[j1 - 1]] += 2 * self.ids
        line, upto = line.tolist(), (upto_a + upto_b).tolist()
        for k, row in enumerate(some):
            told = "".join(map(self.told.__getitem__, line[upto[k] : upto[k + 1]]))
            rows[row] = len(both[row][0]), len(both[row][1]), int(groups[k]), int(links[k]), hashlib.sha256(told[:-1].encode()).hexdigest()
        which, pair, times = self._links(ids_a, ids_b, i1, j1, n, m, of_text)
        return rows, np.array(some)[which], pair, times

    def _links(self, ids_a, ids_b, i1, j1, n, m, of_text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which text, id pair and number, by text and pair. Groups of few links are written out; of larger ones only pairs of distinct ids."""
        few = n * m <= MOST_LINKS
        rows = np.flatnonzero(np.repeat(few, n))  # tokens of A in such groups
        group = np.repeat(np.arange(len(n)), n)[rows]
        times = m[group]
        left = np.repeat(rows, times)
        right = np.repeat((j1 - m)[group], times) + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        code = (of_text[np.repeat(group, times)] * self.ids + ids_a[left]) * self.ids + ids_b[right]
        code.sort()
        first = np.flatnonzero(np.diff(code, prepend=-1))
        code, count = code[first], np.diff(first, append=len(code))
        if not few.all():
            codes, counts = [code], [count]
            for g in np.flatnonzero(~few).tolist():
                (x, nx), (y, ny) = np.unique(ids_a[i1[g] - n[g] : i1[g]], return_counts=True), np.unique(ids_b[j1[g] - m[g] : j1[g]], return_counts=True)
                codes.append((((of_text[g] * self.ids + x) * self.ids)[:, None] + y).ravel())
                counts.append((nx[:, None] * ny).ravel())
            code, where = np.unique(np.concatenate(codes), return_inverse=True)
            total = np.zeros(len(code), np.int64)
            np.add.at(total, where, np.concatenate(counts))
            count = total
        rest, b = np.divmod(code, self.ids)
        which, a = np.divmod(rest, self.ids)
        return which, a << 32 | b, count


@lru_cache(maxsize=2)
def aligner(json_file: str, model_file: str) -> Aligner:
    """Made once in each Python worker."""
    return Aligner(json_file, model_file)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``TOGETHER`` characters of text (the second column), one row at least."""
    begin, size = 0, 0
    for k, n in enumerate(pc.utf8_length(batch.column(1)).to_pylist()):
        if size and size + n > TOGETHER:
            yield batch.slice(begin, k - begin)
            begin, size = k, 0
        size += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


_FIELDS = ("n_a", "n_b", "n_groups", "n_links")
_SCHEMA = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<struct<pair:bigint,times:bigint>>"


def linked(docs: DataFrame, json_file: str, model_file: str) -> DataFrame:
    """One row a document: its numbers of tokens, groups and links, the digest of its groups, and its distinct linked id pairs (A id << 32 | B id) with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(json_file, model_file)
        for batch in batches:
            for part in _slices(batch):
                rows, which, pair, times = made.texts(part.column(1).to_pylist())
                numbers = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
                offsets = pa.array(np.searchsorted(which, np.arange(len(rows) + 1)), pa.int32())
                links = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(pair), pa.array(times)], ["pair", "times"]))
                yield pa.RecordBatch.from_arrays([part.column(0), *numbers, pa.array([r[4] for r in rows], pa.string()), links], ["doc_id", *_FIELDS, "groups_sha256", "links"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(released(run), _SCHEMA)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, documents, best): in how many rows of ``linked`` a pair is, and whether no pair of its A id is in more."""
    counted = rows.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("documents"))
    # At most one row a pair of ids, and few pairs have one A id.
    of_id = Window.partitionBy(F.shiftright("pair", 32))
    return counted.select("pair", "documents", (F.col("documents") == F.max("documents").over(of_id)).alias("best"))


def align(docs: DataFrame, json_file: str, model_file: str, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    rows = linked(docs, json_file, model_file).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "align-rows")
    table = written(pair_counts(rows), "align-pairs")
    links = rows.select("row", F.inline("links"))
    chosen = broadcast_if_small(table, few_pairs)
    told = links.join(chosen, "pair") if chosen is not table else join_by_key(links, table, "pair")
    sums = told.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("documents")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return rows.drop("links").join(sums, "row", "left").select("doc_id", *_FIELDS, zero("n_best"), zero("count_sum"), "groups_sha256")
