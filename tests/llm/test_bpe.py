import hashlib

import public_tokenizers as P
import pytest

from spoor.llm import bpe

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def test_pieces_do_not_change_ids():
    enc = bpe.encoding(RANKS, P.PATTERN)
    for text in ("I'll see 3 cats, it's   fine.\n\n  ok" * 9, "abc123!?'sé漢字 " * 20, "a" * 500, " \t\n " * 50, "don't'll've  x", "é" * 99 + "🎉" * 40):
        for size in (1, 5, 33):
            assert bpe.encode_text(enc, text, size).tolist() == enc.encode_ordinary(text)
            assert "".join(bpe.safe_pieces(text, size)) == text


def test_round_trip(odd_docs, texts):
    enc = bpe.encoding(RANKS, P.PATTERN)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(odd_docs, RANKS, P.PATTERN).collect())
    want = []
    for i, t in texts:
        ids = enc.encode_ordinary(t)
        want.append((i is None, i or 0, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)


def test_encode_then_decode(odd_docs, texts):
    back = bpe.decode(bpe.encode(odd_docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(bytes(r["bytes"]) for r in back) == sorted(t.encode() for _, t in texts)


def test_ids_that_are_no_text(spark):
    enc = bpe.encoding(RANKS, P.PATTERN)
    half = enc.encode_single_token(b"\xc3")
    assert bytes(bpe.decode(spark.createDataFrame([(1, [half])], "doc_id bigint, ids array<bigint>"), RANKS, P.PATTERN).first()["bytes"]) == b"\xc3"


def test_empty(no_docs):
    assert bpe.round_trip(no_docs, RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("size", [10, 1000])
def test_a_run_without_safe_places_stays_whole(size):
    assert list(bpe.safe_pieces("z" * 5000, size)) == ["z" * 5000]
