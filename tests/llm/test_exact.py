import hashlib
from collections import Counter

from pyspark.sql import functions as F

from spoor.llm import exact


def by_force(texts):
    low = lambda i: -1 if i is None else i
    groups = {}
    for i, t in texts:
        groups.setdefault(t, []).append(low(i))
    return Counter((low(i), max(groups[t]), len(groups[t])) for i, t in texts)


def check(found, texts):
    rows = found.collect()
    low = lambda i: -1 if i is None else i
    assert Counter((low(r["doc_id"]), low(r["keep_id"]), r["group_size"]) for r in rows) == by_force(texts)
    assert sum(r["kept"] for r in rows) == len({t for _, t in texts})


def test_groups(odd_docs, texts):
    check(exact.groups(odd_docs), texts)


def test_bytes_decide_when_digests_agree(odd_docs, texts):
    check(exact.groups(odd_docs, digest=lambda text: F.lit("same")), texts)


def test_rows_that_stay(odd_docs, texts):
    kept = exact.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted({t for _, t in texts})


def test_locators_fetch_content(spark, odd_docs, tmp_path):
    odd_docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    found = exact.groups(docs)
    texts = {r["locator"]: r["text"] for r in exact.content(docs, found).collect()}
    rows = found.collect()
    assert len(texts) == len({r["digest"] for r in rows})
    assert all(hashlib.sha256(texts[r["keep_locator"]].encode()).hexdigest() == r["digest"] for r in rows)
    hot = exact.content(docs, found.filter("group_size > 1")).collect()
    assert {r["text"] for r in hot} == {t for t in texts.values() if sum(x["digest"] == hashlib.sha256(t.encode()).hexdigest() for x in rows) > 1}


def test_empty(no_docs):
    assert exact.groups(no_docs).count() == 0 and exact.deduplicated(no_docs).count() == 0


def test_state_goes_on(spark, tmp_path):
    """A second run of one checkpoint reads only what the log has gained, and counts it to the same keys."""
    log, schema = f"file://{tmp_path}/log", "digest string, entry struct<doc_id:bigint,seq:bigint,locator:string>"
    make = lambda ids: spark.createDataFrame([("d", (i, i, str(i))) for i in ids], schema)
    make([1, 5]).write.parquet(log)
    first = exact.keyed_state(log, make([1]).schema, spark, f"file://{tmp_path}/cp").collect()
    assert [(r["n_rows"], r["keep"]["doc_id"]) for r in first] == [(2, 5)]
    make([9, 2]).write.mode("append").parquet(log)
    second = exact.keyed_state(log, make([1]).schema, spark, f"file://{tmp_path}/cp").collect()
    assert [(r["n_rows"], r["keep"]["doc_id"]) for r in second] == [(4, 9)]
