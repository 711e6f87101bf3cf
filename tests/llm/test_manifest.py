"""The manifest against trees built in order on the driver."""

import hashlib
import random
import zlib

from spoor.llm import manifest

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """The root, and for each leaf the siblings before and after it by level."""
    paths, owned = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, owners = [], []
        for s in range(0, len(nodes), 3):
            run = nodes[s : s + 3]
            for j in range(len(run)):
                for i in owned[s + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(sha("".join(run)))
            owners.append(sum(owned[s : s + 3], []))
        nodes, owned = above, owners
    return nodes[0], paths


def expected(rows):
    leaf = lambda r, text: sha("".join(map(field, (*r[:4], text))))
    by_source, whole, out = {}, [], []
    for r in rows:
        by_source.setdefault(r[1], []).append((r, leaf(r, r[4])))
    for source in sorted(by_source, key=lambda s: (s is not None, (s or "").encode())):
        some = sorted(by_source[source], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        whole.append((some, *tree([digest for _, digest in some])))
    root, tops = tree([w[1] for w in whole])
    for (some, subroot, paths), top in zip(whole, tops):
        for (r, digest), path in zip(some, paths):
            text = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            folded = leaf(r, text)
            for before, after in path + top:
                folded = sha(before + folded + after)
            out.append((r[0], digest, subroot, root, sha("".join(b + a for b, a in path + top)), folded, folded == root))
    return sorted(out, key=lambda x: tuple(map(str, x)))


def found(docs):
    return sorted((tuple(r[c] for c in COLUMNS) for r in manifest.manifest(docs).collect()), key=lambda x: tuple(map(str, x)))


def rows_of(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def test_odd_rows(odd_docs):
    """Nulls everywhere, repeated rows and ids, empty and long texts, extra columns with clashing names."""
    assert found(odd_docs) == expected(rows_of(odd_docs))


def test_no_rows(no_docs):
    assert found(no_docs) == []


def test_one_row(spark):
    docs = spark.createDataFrame([(7, None, None, None, "a\nb")], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert found(docs) == expected(rows_of(docs))


def test_sparse_negative_and_repeated_ids_in_a_hot_source(spark, monkeypatch):
    """More than one round of groups, ids far apart, words of 64 ids with repeats, and no broadcast of bitmaps."""
    monkeypatch.setattr(manifest, "FEW_CONTAINERS", 0)
    random.seed(5)
    ids = [None, 5, 5, 7, -3, 1 << 40, -(1 << 62)]
    rows = [(random.choice([*ids, (1 << 62) + i, i, i, -i]), random.choice(["hot", "hot", "hot", None, "ä", f"s{i % 90}"]), "en", i % 9 or None, random.choice([None, "", "x\ny", str(i)])) for i in range(700)]
    docs = spark.createDataFrame(rows + rows[:30], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert found(docs) == expected(rows + rows[:30])


def test_ranks_are_places_in_order(spark):
    ids = [3, -70, 64, 65, 1 << 17, (1 << 17) + 1, 1 << 50, -(1 << 50), 0]
    rows = spark.createDataFrame([(0, i, str(i)) for i in ids], "tree bigint, doc_id bigint, leaf string")
    assert {r["doc_id"]: r["at"] for r in manifest.placed(rows).collect()} == {i: k for k, i in enumerate(sorted(ids))}
