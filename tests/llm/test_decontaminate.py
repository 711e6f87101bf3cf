"""Decontamination against a search for every window at every place."""

import hashlib
import random
import re

import pytest

from spoor.llm import common, decontaminate

FIELDS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[s : s + 10]), set()).add("" if i is None else str(i))
    out = []
    for i, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if found := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    ids |= found
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def found(docs, items, **how):
    return sorted((tuple(r[c] for c in ("doc_id", *FIELDS)) for r in decontaminate.contamination(docs, items, **how).collect()), key=str)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "The quick brown fox jumps over the lazy dog near the river bank"), (2, "WORD word"), (3, "naïve ÜBER straße"), (4, None), (5, ""), (None, "the id of another"), (7, "the id of another"), (8, "x"), (9, "... --")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_odd_rows(odd_docs, texts, items):
    """Short items of one to four words, equal items, null ids, null and empty texts on both sides, repeated rows, very long texts."""
    assert found(odd_docs, items) == expected(texts, [tuple(r) for r in items.collect()])


def test_planted_spans_across_pieces(spark, monkeypatch):
    """Spans of every length around a window's, over the ends of pieces; broadcasts and shuffles give the same."""
    random.seed(2)
    word = lambda: random.choice(["Alpha", "beta", "gamma", "Ünder", "漢字", "d4"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([10, 11, 30, 9, 6, 5, 4, 60])]
    docs = []
    for k in range(60):
        text = [word() for _ in range(random.randrange(40))]
        source = words(random.choice(items)[1])
        start = random.randrange(max(1, len(source) - 8))
        text += source[start : start + random.randrange(3, 14)] + [word() for _ in range(random.randrange(30))]
        docs.append((k, random.choice([" ", ", ", "\n"]).join(text)))
    made = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = expected(docs, items)
    assert found(*made, piece_words=16) == want
    monkeypatch.setattr(decontaminate, "broadcast_if_small", lambda df, most=0: df)
    assert found(*made) == want
    assert common.BROADCAST_ROWS > 0


def test_empty_tables(spark, odd_docs, no_docs, items, texts):
    assert found(no_docs, items) == []
    assert found(odd_docs, items.limit(0)) == expected(texts, [])


def test_every_long_span_keeps_a_fingerprint(spark):
    """The least hash of a window is kept whatever stands around it."""
    from pyspark.sql import functions as F

    random.seed(4)
    rows = [([random.randrange(4) for _ in range(n)],) for n in (3, 5, 10, 25, 60)]
    kept = decontaminate.winnowed(decontaminate.grams(F.col("h"), 5), 6)
    for h, places in spark.createDataFrame(rows, "h array<bigint>").select("h", F.transform(kept, lambda x: -x["at"])).collect():
        assert all(any(s <= p <= s + 5 for p in places) for s in range(len(h) - 9))
        assert len(places) == len(set(places))
