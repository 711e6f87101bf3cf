"""Chunk deduplication against brute force over all windows of bytes, in both directions."""

import random

import numpy as np

from spoor.llm import chunks

N = chunks.MIN_BYTES
SURE = chunks.GRAM + 2 * chunks.WINDOW + N


def letters(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def spans_of(row):
    return [tuple(map(int, s.split(":"))) for s in row["spans"].split(",") if s]


def stretches(own: bytes, others: list[bytes], least: int) -> list[tuple[int, int]]:
    """Maximal stretches of at least ``least`` bytes that one of ``others`` has in one piece."""
    out = []
    for other in others:
        seeds = {other[k : k + least] for k in range(len(other) - least + 1)}
        s = 0
        while s + least <= len(own):
            if own[s : s + least] not in seeds:
                s += 1
                continue
            e = s + least
            while e < len(own) and own[s : e + 1] in other:
                e += 1
            out.append((s, e))
            s += 1
    return out


def compare(spark, texts, ids=None, edge=chunks.WINDOW):
    """Soundness and completeness of every span; what is cut out stays in another row."""
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").coalesce(3)
    rows = chunks.report(df).collect()
    assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in rows)
    data = [t.encode() for t in texts]
    if len(set(ids)) == len(ids):
        by_id = {r["doc_id"]: r for r in rows}
        for i, own in zip(ids, data):
            others = [d for j, d in zip(ids, data) if j != i]
            flagged = set()
            for s, e in spans_of(by_id[i]):
                flagged.update(range(s, e))
                # every byte of a span is in N bytes or more that one other text has
                inside = set()
                for a, b in stretches(own[s:e], others, N):
                    inside.update(range(s + a, s + b))
                assert inside == set(range(s, e)), i
            for s, e in stretches(own, others, SURE):
                assert flagged.issuperset(range(s + chunks.GRAM + edge, e - edge - chunks.WINDOW)), (i, s, e)
            assert by_id[i]["repeated_bytes"] == len(flagged)
    after = sorted((str(r["doc_id"]), r["text"]) for r in chunks.deduplicated(df).collect())
    kept = [t.encode() for _, t in after]
    for own in data:  # nothing that was cut is gone altogether
        for s in range(0, len(own) - 23):
            gram = own[s : s + 24]
            if b" " not in gram and gram not in b"\0".join(kept):
                raise AssertionError(gram)
    assert len(after) == len(texts)
    return rows, after


def test_spans_against_brute_force(spark):
    rng = random.Random(11)
    runs = [letters(rng, 90)[: SURE + k] for k in (0, 1, 30, 150)] + [letters(rng, 60)[: N + k] for k in (0, 40)]
    texts = [letters(rng, 100) for _ in range(8)]
    for run in runs:
        texts += [f"{letters(rng, rng.randrange(40))} {run} {letters(rng, 20)}" for _ in range(3)]
    texts += [runs[3][:200] + letters(rng, 30), letters(rng, 30) + runs[3][60:]]
    rows, _ = compare(spark, texts)
    found = {r["doc_id"]: r for r in rows}
    assert not any(found[i]["repeated"] for i in range(8))
    assert all(found[i]["repeated"] for i in range(8, 20)) and found[8]["removed_bytes"] == 0 < found[9]["removed_bytes"] and found[9]["first_doc_ids"] == [8]


def test_short_repeats_in_other_orders_are_left_alone(spark):
    rng = random.Random(12)
    phrases = [letters(rng, 7) for _ in range(60)]
    apart, seen = [], set()
    for _ in range(300):
        order = rng.sample(phrases, 10)
        if not seen & (pairs := set(zip(order, order[1:]))):
            apart.append(order)
            seen |= pairs
    df = spark.createDataFrame([(i, " ".join(o)) for i, o in enumerate(apart)], "doc_id bigint, text string")
    assert len(apart) > 5 and chunks.report(df).filter("repeated").count() == 0


def test_one_word_repeated(spark):
    rng = random.Random(13)
    texts = ["word " * 155, "start " + "word " * 155 + "end", "word " * 19, "".join(rng.choice("abc") for _ in range(300)), "a" * 800, "b" + "a" * 450, "ab" * 160]
    rows, _ = compare(spark, texts, edge=2 * chunks.WINDOW)
    found = {r["doc_id"]: r["repeated"] for r in rows}
    assert [found[i] for i in range(7)] == [True, True, False, False, True, True, False]
    assert len(chunks.chunks([b"a" * 100_000])[0][0]) < 100_000 / chunks.WINDOW + 3  # few chunks where one byte repeats


def test_rows_of_one_id_and_of_none(spark):
    rng = random.Random(15)
    run, own, other = letters(rng, 100), letters(rng, 100), letters(rng, 100)
    rows = [(7, own), (7, other), (7, f"{letters(rng, 20)} {run}"), (None, run), (None, run), (3, f"{run} {letters(rng, 20)}"), (7, own)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    told = chunks.report(df).collect()
    flags = sorted((r["doc_id"] or 0, r["repeated"], r["removed_bytes"] > 0) for r in told)
    assert flags == [(0, True, True), (0, True, True), (3, True, False), (7, False, False), (7, True, False), (7, True, True), (7, True, True)]
    after = sorted((r["doc_id"] or 0, r["text"]) for r in chunks.deduplicated(df).collect())
    texts = [t for _, t in after]
    assert texts.count(own) == 1 and texts.count("") == 3 and other in texts and rows[5][1] in texts  # one of the two equal rows keeps its text


def test_whole_characters(spark):
    run = "漢字é" * 60
    compare(spark, ["x" + run + "y", "zz" + run, "字é" + "漢字é" * 59 + "漢", "other words"], edge=2 * chunks.WINDOW)


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(14)
    text = ("".join(rng.choice("abcdefgh ") for _ in range(9000)) + "漢字é" * 300 + "a" * 3000).encode()
    whole = chunks.chunks([text])[0]
    alone = chunks.chunks([b"", text, text[500:], b"x"])
    monkeypatch.setattr(chunks, "PIECE", 1 << 10)
    for a, b, c in zip(whole, chunks.chunks([text])[0], alone[1]):
        assert np.array_equal(a, b) and np.array_equal(a, c)
    assert set(alone[2][2].tolist()) & set(whole[2].tolist()) and not alone[0][0].size and not alone[3][0].size


def test_cuts_by_force():
    rng = random.Random(16)
    text = letters(rng, 300).encode()
    h, key = 0, {}
    for i, byte in enumerate(text[:-1]):
        h = (2 * h + int(chunks.GEAR[byte])) & 0xFFFF
        key[i + 1] = (not (text[i : i + 1] == b" " and text[i + 1 : i + 2] != b" "), h, i + 1)
    want = {min((key[p] for p in range(s, s + chunks.WINDOW)))[2] for s in range(chunks.GRAM, len(text) - chunks.WINDOW + 1)}
    assert chunks.cuts([text])[0].tolist() == [0, *sorted(want), len(text)]
