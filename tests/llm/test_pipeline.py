"""The pipeline's stages, on given documents and on odd rows, against brute force."""

import hashlib
import math
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import public_tokenizers as P
import pytest
from test_jaccard import by_force

import corpus_pipeline
from spoor.llm import bpe, mixing, queries, toxicity

DATA = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not Path(DATA).exists(), reason="no given tables")
STAGES = dict(corpus_pipeline.STAGES)


def mix_by_force(rows):
    """Documents (by number of the row) in training order: targets by rounds, positions by bisection."""
    words = lambda t: len([w for w in __import__("re").findall(mixing.WORD, t or "")])
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(words(r["text"]) for r in rows if r["source"] == s) for s in sources}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(own.values()), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * own[s] <= weight[s] * level + 1e-9}
        target |= {s: 2.0 * own[s] if s in full else weight[s] * level for s in (full or open_)}
        left -= sum(target[s] for s in full)
        open_ -= full or open_
    out = []
    for k, s in enumerate(sources):
        (t0, r0), (_, r1) = mixing.SCHEDULES[k % 3]
        share = lambda t: (r0 * t + (r1 - r0) * t * t / 2) / ((r0 + r1) / 2)  # noqa: B023, E731
        mine = [(hashlib.md5(str(r["doc_id"] if r["doc_id"] is not None else "").encode()).hexdigest(), i) for i, r in enumerate(rows) if r["source"] == s]
        before = 0
        for _, i in sorted(mine) * 2:
            size = words(rows[i]["text"])
            if size and before < math.floor(target[s]):
                low, high = 0.0, 1.0
                for _ in range(60):
                    mid = (low + high) / 2
                    low, high = (mid, high) if share(mid) < before / target[s] else (low, mid)
                out.append((round(low, 9), rows[i]["doc_id"]))
            before += size
    return [d for _, d in sorted(out)]


def near_groups(rows):
    """The ids that stay: of each class the least."""
    cls, _ = by_force([(r["doc_id"], r["text"] or "") for r in rows])
    least = defaultdict(list)
    for r, c in zip(rows, cls):
        least[c].append(r["doc_id"])
    return {min(ids) for ids in least.values()}


@given
def test_stages_by_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    rows = [r.asDict() for r in docs.collect()]

    def run(name, docs):
        STAGES[name](spark, docs, DATA).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        return out, [r.asDict() for r in out.collect()]

    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    clean, found = run("toxicity", docs)
    assert clean.columns == columns
    assert sorted(r["doc_id"] for r in found) == sorted(r["doc_id"] for r in rows if model.score([r["text"] or ""])[0] < 0.5)

    rows, last = found, {}
    for r in rows:
        last[r["text"] or ""] = max(last.get(r["text"] or "", -1), r["doc_id"])
    unique, found = run("exact_dedup", clean)
    assert unique.columns == columns and sorted(r["doc_id"] for r in found) == sorted(last.values())

    kept = near_groups(found)
    apart, found = run("near_dedup", unique)
    assert apart.columns == columns and {r["doc_id"] for r in found} == kept and len(found) == len(kept)

    rows = found
    mixed, found = run("mix", apart)
    assert mixed.columns == columns
    want = mix_by_force(rows)
    assert Counter(r["doc_id"] for r in found) == Counter(want)

    enc = bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = {r["doc_id"]: r["text"] or "" for r in rows}
    encoded = [r.asDict() for r in STAGES["encode"](spark, mixed, DATA).collect()]
    for r in encoded:
        assert r["ids"] == enc.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    # however the files are dealt to tasks, positions give the training order back
    assert len({r["position"] for r in encoded}) == len(encoded)
    assert [r["doc_id"] for r in sorted(encoded, key=lambda r: r["position"])] == want


@pytest.mark.parametrize("name", list(STAGES))
def test_odd_rows_and_none(spark, odd_docs, no_docs, name, tmp_path):
    labels = spark.createDataFrame([(0, 1, 1), (None, 0, 0), (1, None, None), (5, 1, 0)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    found = STAGES[name](spark, odd_docs, str(tmp_path))
    n = found.count()
    assert STAGES[name](spark, no_docs, str(tmp_path)).count() == 0
    if name == "encode":
        assert n == odd_docs.count() and found.filter("position is not null").count() == 0
        return
    assert found.columns == odd_docs.columns and found.schema["digest"].dataType == odd_docs.schema["digest"].dataType
    rows, there = [tuple(r) for r in found.collect()], Counter(tuple(r) for r in odd_docs.collect())
    assert set(rows) <= set(there)
    texts = Counter((r["text"] or "") for r in odd_docs.collect())
    if name == "toxicity":
        assert all(Counter(rows)[r] in (0, there[r]) for r in there)  # equal rows share their fate
    if name == "exact_dedup":
        assert n == len(texts)
    if name == "near_dedup":
        assert n == len({" ".join(t.lower().split()) for t in texts})
    if name == "mix":
        assert n and all(r[1] and r[1].split() for r in rows)


@given
def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mix", "encode"]
    found = corpus_pipeline.run(spark, DATA)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "position"] and found.count() > 0


@given
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_agree_with_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    found, expected = queries.QUERIES[name](spark, DATA), db.sql(queries.ORACLE[name])
    rows = lambda names, values: sorted(tuple(str(r[i]) for i in sorted(range(len(names)), key=names.__getitem__)) for r in values)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(expected.columns, expected.fetchall())


def test_names():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
