"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Each text is encoded whole, every match of the pattern separately, without
special tokens. Texts longer than ``chunk_chars`` are first cut at places where
the pattern ends a match whatever stands around them, so that the ids are those
of the uncut text; a run without such a place stays in one piece.

Defined results: null counts as the empty text (no ids, the digest of no
bytes); repeated rows give repeated rows; an empty table gives an empty table;
other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, text_of

#: Between a character that is no white space and a blank or newline, or between
#: a letter or digit and a following symbol, no match of the pattern continues.
_SAFE = re.compile(r"(?<=\S)(?=[ \n])|(?<=[^\W_])(?=[^\w\s])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The encoding of a rank file, made once in each Python worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("spoor", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, chunk_chars: int) -> Iterator[str]:
    """``text`` in pieces of about ``chunk_chars``, cut at safe places only."""
    start = 0
    while len(text) - start > chunk_chars:
        cut = _SAFE.search(text, start + chunk_chars)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc, text: str, chunk_chars: int = 1 << 16) -> np.ndarray:
    parts = [enc.encode_to_numpy(piece, disallowed_special=()) for piece in safe_pieces(text, chunk_chars)]
    return np.concatenate(parts).astype("<u4", copy=False)


def decode_ids(enc, ids: np.ndarray) -> bytes:
    return enc.decode_bytes(ids.tolist())


def _per_row(make: Callable, fields: list[tuple[str, pa.DataType]]):
    """An Arrow map that keeps ``doc_id`` and what follows the second column, which it turns into ``fields``, row by row within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows = [make(x.as_py()) for x in part.column(1)]
                columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, *part.columns[2:]], ["doc_id", *[n for n, _ in fields], *part.schema.names[2:]])

    return released(run)


def encode(docs: DataFrame, rank_file: str, pattern: str, chunk_chars: int = 1 << 16) -> DataFrame:
    """(doc_id, ids array<bigint>) of every text."""
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(
        _per_row(lambda t: (encode_text(encoding(rank_file, pattern), t, chunk_chars).astype("int64"),), [("ids", pa.list_(pa.int64()))]), "doc_id bigint, ids array<bigint>"
    )


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, bytes binary): the raw bytes of the ids, valid UTF-8 or not."""
    return encoded.select("doc_id", "ids").mapInArrow(
        _per_row(lambda ids: (decode_ids(encoding(rank_file, pattern), np.asarray(ids or [], "<u4")),), [("bytes", pa.binary())]), "doc_id bigint, bytes binary"
    )


def round_trip(docs: DataFrame, rank_file: str, pattern: str, chunk_chars: int = 1 << 16, position: Column | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode every text, decode its ids, and return digests of both in one pass over the table; with a training ``position`` and the ids themselves if asked."""

    def digests(text: str):
        enc = encoding(rank_file, pattern)
        ids = encode_text(enc, text, chunk_chars)
        told = len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode_ids(enc, ids)).hexdigest()
        return (*told, ids.astype("int32")) if keep_ids else told

    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + ([("ids", pa.list_(pa.int32()))] if keep_ids else [])
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "") + ("" if position is None else ", position bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), *([] if position is None else [position.alias("position")]))
    return rows.mapInArrow(_per_row(digests, fields), schema)
