import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoor.llm import jaccard


def gram_set(text):
    w = text.lower().split()
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)])


def by_force(texts):
    sets = [gram_set(t) for _, t in texts]
    cls = list(range(len(texts)))
    links = [0] * len(texts)

    def root(i):
        while cls[i] != i:
            i = cls[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                cls[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))], links


def near_docs(spark, n=400):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(120)] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(base[0] if i % 3 == 0 else base[rng.randrange(12)])  # one group holds a third of all rows
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w[: rng.choice([120, 120, 110])])))
    return rows


def test_links_and_classes_by_force(spark, monkeypatch):
    rows = near_docs(spark)
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # many block pairs
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    cls, links = by_force(rows)
    assert got == {i: (cls[i], links[i]) for i in range(len(rows))}


def test_chain_of_likes(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2200)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 120])) for i in range(340)]  # each is like the two before and after it, all are one class
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["class_id"], r["links"]) for r in jaccard.classes(df).collect()}
    cls, links = by_force(rows)
    assert got == {i: (cls[i], links[i]) for i in range(len(rows))} and set(cls) == {0}
    signed = df.withColumn("version", F.lit(0).cast("bigint")).select("doc_id", "version", "text").mapInArrow(jaccard._sign, "doc_id bigint, version bigint, digest binary, bands array<bigint>, words bigint")
    placed = jaccard._placed(signed.withColumnRenamed("doc_id", "node").drop("version", "digest"))
    sizes = [r["n"] for r in placed.select(F.explode("places.target").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(sizes) < 40 and sum(sizes) < 40 * len(rows)  # groups are local, none holds the chain


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no given tables")
def test_given_documents_by_inverted_index(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    sets, holders, common = {}, defaultdict(list), Counter()
    for i, t in texts:
        sets[i] = gram_set(t)
        for g in sets[i]:
            holders[g].append(i)
    for ids in holders.values():
        common.update((a, b) for k, a in enumerate(ids) for b in ids[:k])
    links = Counter()
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links.update((a, b))
    assert {r["doc_id"]: r["links"] for r in jaccard.classes(docs).collect()} == {i: links[i] for i, _ in texts} and sum(links.values())


def test_odd_rows(odd_docs, texts):
    rows = jaccard.classes(odd_docs).collect()
    _, links = by_force(texts)
    assert Counter(r["links"] for r in rows) == Counter(links)


def test_one_of_each_class_stays(odd_docs, spark, texts):
    cls, _ = by_force(texts)
    kept = jaccard.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(set(cls))
    rows = near_docs(spark, 100)
    cls, _ = by_force(rows)
    kept = jaccard.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r["doc_id"] for r in kept.collect()} == set(cls)


def test_empty(no_docs):
    assert jaccard.classes(no_docs).count() == 0 and jaccard.deduplicated(no_docs).count() == 0


def test_posterior_keeps_likely_pairs():
    least = jaccard.least_matches(0.8, 1e-6)
    assert all(a < b for a, b in zip(least, least[1:])) and least[-1] < 0.8 * jaccard.N_HASHES
    rng = np.random.default_rng(1)
    draws = rng.random((20_000, jaccard.N_HASHES)) < 0.8
    for k, m in enumerate(least):
        assert (draws[:, : (k + 1) * jaccard.STEP].sum(axis=1) >= m).mean() > 0.999


def test_minhash_estimates():
    rng = np.random.default_rng(2)
    both, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    a, b = jaccard.minhash(np.concatenate([both, one])), jaccard.minhash(np.concatenate([both, two]))
    assert abs((a == b).mean() - 0.8) < 0.12
