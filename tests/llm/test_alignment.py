"""Alignment against sets of common ends, and the corpus-wide counts against loops."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from spoor.llm import alignment

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*FILES)


def groups(text, aligner):
    """Groups as (A ids, B ids), by walking along the common ends; None if there are no tokens."""
    if not text:
        return None
    a, b = alignment.library_encode(FILES[0])(" " + text), aligner.encode_b(text)
    bytes_a, bytes_b = [aligner.bytes_a[i] for i in a], [aligner.bytes_b[i] for i in b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    out, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        i1, j1 = ends_a.index(end) + 1, ends_b.index(end) + 1
        out.append((a[i:i1], b[j:j1]))
        i, j = i1, j1
    return out


def expected(texts, aligner):
    made = [groups(t, aligner) for t in texts]
    links = [Counter((x, y) for a, b in g or [] for x in a for y in b) for g in made]
    documents = Counter(p for each in links for p in each)
    best = defaultdict(int)
    for (x, _), n in documents.items():
        best[x] = max(best[x], n)
    line = lambda g: hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g).encode()).hexdigest()
    return [
        (sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(each.values()), sum(n for p, n in each.items() if documents[p] == best[p[0]]),
         sum(n * documents[p] for p, n in each.items()), line(g) if g else "")
        for g, each in zip(made, links)
    ]


TEXTS = ["The quick brown fox, isn't it? <|endoftext|> </s> über straße\n\n  two  spaces ", "ab" * 700, "▁ under", "漢字テスト \U0001f389 x", "\x00\x01 a", "the the the the", " ", "\n", "trail  "]


@pytest.mark.parametrize("few_pairs", [1_000_000, 0])
def test_odd_rows(odd_docs, texts, aligner, few_pairs):
    """Null, empty and long texts, repeated rows and ids; with the pairs broadcast and not."""
    found = alignment.align(odd_docs, *FILES, few_pairs=few_pairs).collect()
    want = expected([t for _, t in texts], aligner)
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], *(r[f] for f in FIELDS)) for r in found), key=key) == sorted(((i, *w) for (i, _), w in zip(texts, want)), key=key)


def test_odd_texts(spark, aligner):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    found = {r["doc_id"]: tuple(r[f] for f in FIELDS) for r in alignment.align(docs, *FILES).collect()}
    assert [found[k] for k in range(len(TEXTS))] == expected(TEXTS, aligner)
    assert found[2] == (0, 0, 0, 0, 0, 0, "")  # B gives a space back


def test_no_rows(no_docs):
    assert alignment.align(no_docs, *FILES).collect() == []


def test_cuts_are_the_common_ends():
    random = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 400):
        for share in (0.02, 0.3, 0.9):
            a = np.unique(np.r_[random.choice(n * 4, n), n * 4])
            b = np.unique(np.r_[random.choice(n * 4, n), a[random.random(len(a)) < share], n * 4])
            one = np.array([0])
            i, j = alignment.shared_cuts(a, b, one, one, np.array([len(a)]), one, np.array([len(b)]))
            assert a[i - 1].tolist() == b[j - 1].tolist() == np.intersect1d(a, b).tolist()


def test_large_groups_yield_the_same_links(aligner, monkeypatch):
    texts = [t for t in TEXTS if t] + ["a " * 50]
    before = aligner.texts(texts)
    monkeypatch.setattr(alignment, "MOST_LINKS", 1)
    after = aligner.texts(texts)
    assert before[0] == after[0] and all((x == y).all() for x, y in zip(before[1:], after[1:]))


def test_fast_ids_are_the_library_s(aligner):
    other = alignment.library_encode(FILES[0])
    for text in TEXTS:
        assert list(aligner.encode_a(" " + text)) == other(" " + text)
