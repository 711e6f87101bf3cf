from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spoor.llm import mixing


def test_targets_and_words(odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    total = sum(r["size"] for r in rows)
    goals, taken = {}, defaultdict(int)
    for r in rows:
        goals[r["source_size"], r["target"]] = r["target"]
        taken[r["source_size"], r["target"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"]
    assert sum(goals.values()) == pytest.approx(1.5 * total)
    for k, goal in goals.items():
        assert taken[k] == int(goal)


def test_water_level_by_rounds(spark):
    sizes = [("a", 10), ("b", 400), ("c", 30), ("d", 7), ("e", 300), (None, 100)]
    found = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size bigint")).collect()}
    weights = dict(zip([s for s, _ in sizes], [3, 1, 2, 3, 1, 2]))
    left, open_, want = 1.5 * sum(n for _, n in sizes), dict(sizes), {}
    while True:
        level = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if weights[s] * level >= 2 * open_[s]]
        if not full:
            want |= {s: weights[s] * level for s in open_}
            break
        for s in full:
            want[s] = 2.0 * open_.pop(s)
            left -= want[s]
    assert found == pytest.approx(want)


def test_time_inverts_the_integral(spark):
    knots = ((0.0, 0.5), (0.25, 2.0), (0.6, 0.1), (1.0, 1.0))
    area = lambda t: sum(max(0.0, min(t, b) - a) * (r + (r + (s - r) * (min(t, b) - a) / (b - a))) / 2 for (a, r), (b, s) in zip(knots, knots[1:]) if t > a)
    times = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(t, area(t) / area(1.0)) for t in times], "t double, u double")
    for r in df.select("t", mixing.time_of(F.col("u"), knots).alias("x")).collect():
        assert r["x"] == pytest.approx(r["t"], abs=1e-6)


def test_order_and_repeats(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (i % 7 + 1), f"s{i % 2}") for i in range(200)], "doc_id bigint, text string, source string")
    plan = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert plan == {r["doc_id"]: r for r in mixing.mix(docs.repartition(7)).collect()}
    out = mixing.mixed(docs).collect()
    counts = defaultdict(int)
    for r in out:
        counts[r["doc_id"]] += 1
    assert set(counts.values()) <= {1, 2}
    assert all(counts[i] == sum(t > 0 for t in r["takes"]) for i, r in plan.items())


def test_odd_and_empty(odd_docs, no_docs):
    assert mixing.mixed(odd_docs).columns == odd_docs.columns
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0


def test_no_words(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix(docs).collect()] == [(0.0, 0)] * 2
