"""The numbered queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chunks, decontaminate, exact, fingerprint, html, jaccard, licenses, manifest, mixing, secrets, toxicity
from .common import table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.coalesce(F.round("position", 9), F.lit(-1.0)).alias("position"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_paths(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans")
    )


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact.groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", F.col("links").alias("n_links"), "copies")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.report(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_bpe": op1_bpe, "op2_toxicity": op2_toxicity, "op3_html": op3_html, "op4_fingerprint": op4_fingerprint, "op5_chunks": op5_chunks, "op6_mix": op6_mix,
    "op7_secrets": op7_secrets, "op8_licenses": op8_licenses, "op9_exact": op9_exact, "op10_jaccard": op10_jaccard,
    "op11_manifest": op11_manifest, "op12_alignment": op12_alignment, "op13_leaks": op13_leaks,
}

_SIZES = r"SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents"

#: The key formats that op7 adds to the base.
_KEY_FORMATS = (
    ("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"), ("github", "gh[pousr]_[A-Za-z0-9]{36,}"), ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"), ("google", "AIza[0-9A-Za-z_-]{35,}"),
)

ORACLE = {
    "op6_mix": f"""
WITH sizes AS ({_SIZES}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, (SELECT sum(source_size) FROM w)::DOUBLE * 1.5::DOUBLE AS budget,
        (SELECT sum(source_size) FROM w)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0) AS words_left,
        (SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0) AS weight_left
      FROM w WINDOW b AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * weight_left <= weight * words_left AS is_full FROM l),
t AS (SELECT source, source_size, rank, CASE WHEN is_full THEN cap ELSE weight * (budget - coalesce((SELECT sum(cap) FROM f WHERE is_full), 0)) / (SELECT sum(weight) FROM f WHERE NOT is_full) END AS target FROM f),
d AS (SELECT z.doc_id, z.size, t.source_size, t.target, t.rank, sum(z.size) OVER (PARTITION BY t.rank ORDER BY md5(coalesce(CAST(z.doc_id AS VARCHAR), '')), z.doc_id NULLS LAST, z.size ROWS UNBOUNDED PRECEDING) - z.size AS words_before
      FROM sizes z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - words_before)) AS one, greatest(0, least(size, CAST(floor(target) AS BIGINT) - words_before - source_size)) AS two, words_before / target AS u FROM d)
SELECT doc_id, size, source_size, target, CAST(one + two AS BIGINT) AS taken,
  coalesce(CASE WHEN one > 0 THEN round(CASE rank % 3 WHEN 0 THEN 2 * u / (0.5 + sqrt(0.25 + 2 * u)) WHEN 1 THEN 2 * u / (1.5 + sqrt(greatest(2.25 - 2 * u, 0))) ELSE u END, 9) END, -1.0::DOUBLE) AS position
FROM g""",
    "op7_secrets": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
rules(kind, rank, pattern, grp, least) AS (VALUES
  ('assign', 0, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 8),
  ('access', 1, '(AKIA)([A-Z0-9]+)', 0, 16), ('hex', 2, '([0-9a-f])([0-9a-f]*)', 0, 32)),
m AS (
  SELECT doc_id, 'assign' AS kind, 0 AS rank, 8 AS least, regexp_extract_all(text, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS whole,
    regexp_extract_all(text, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS part,
    regexp_split_to_array(text, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps FROM d
  UNION ALL SELECT doc_id, 'access', 1, 16, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_split_to_array(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT doc_id, 'hex', 2, 32, regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_split_to_array(text, '[0-9a-f]+') FROM d
"""
    + "".join(f"  UNION ALL SELECT doc_id, '{kind}', {rank}, 0, regexp_extract_all(text, '{p}'), regexp_extract_all(text, '{p}'), regexp_split_to_array(text, '{p}') FROM d\n" for rank, (kind, p) in enumerate(_KEY_FORMATS, 3))
    + r"""),
x AS (SELECT doc_id, kind, rank, least, generate_subscripts(whole, 1) AS i, unnest(whole) AS match, unnest(part) AS part, unnest(gaps[1:len(whole)]) AS gap FROM m WHERE len(whole) > 0),
e AS (SELECT *, sum(length(gap) + length(match)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM x),
s AS (SELECT doc_id, kind, rank, CAST(stop - length(match) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM e WHERE length(part) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < 3) AS base FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)""",
    "op9_exact": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_manifest": """
WITH RECURSIVE f AS (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM (
    SELECT doc_id, source, lang, n_chars, text, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) END AS crc FROM documents)),
head AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS start FROM f),
l AS (SELECT doc_id, source, sha256(start || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(start || coalesce(strlen(tampered) || ':' || tampered, '-')) AS presented FROM head),
r AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM l),
lv AS (SELECT tree, 0 AS level, idx, leaf AS h, n FROM r UNION ALL SELECT tree, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM lv WHERE n > 1 GROUP BY tree, level, idx // 3, n),
sub AS (SELECT tree, h AS subroot FROM lv WHERE n = 1),
tv AS (SELECT 0 AS level, tree AS idx, subroot AS h, (SELECT count(*) FROM sub) AS n FROM sub UNION ALL SELECT level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM tv WHERE n > 1 GROUP BY level, idx // 3, n),
steps AS (
  SELECT r.tree, r.idx, 0 AS part, v.level, coalesce(string_agg(v.h, '' ORDER BY v.idx) FILTER (v.idx < r.idx // (3 ** v.level)::BIGINT), '') AS b, coalesce(string_agg(v.h, '' ORDER BY v.idx) FILTER (v.idx > r.idx // (3 ** v.level)::BIGINT), '') AS a
  FROM r JOIN lv v ON v.tree = r.tree AND v.n > 1 AND v.idx // 3 = r.idx // (3 ** (v.level + 1))::BIGINT GROUP BY r.tree, r.idx, v.level
  UNION ALL SELECT r.tree, r.idx, 1, v.level, coalesce(string_agg(v.h, '' ORDER BY v.idx) FILTER (v.idx < r.tree // (3 ** v.level)::BIGINT), ''), coalesce(string_agg(v.h, '' ORDER BY v.idx) FILTER (v.idx > r.tree // (3 ** v.level)::BIGINT), '')
  FROM r JOIN tv v ON v.n > 1 AND v.idx // 3 = r.tree // (3 ** (v.level + 1))::BIGINT GROUP BY r.tree, r.idx, v.level),
p AS (SELECT tree, idx, string_agg(b || a, '' ORDER BY part, level) AS proof, list({'b': b, 'a': a} ORDER BY part, level) AS s FROM steps GROUP BY tree, idx),
o AS (SELECT r.doc_id, r.leaf, sub.subroot, (SELECT h FROM tv WHERE n = 1) AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
    list_reduce(list_prepend({'b': r.presented, 'a': ''}, coalesce(p.s, [])), lambda x, y: {'b': sha256(y.b || x.b || y.a), 'a': ''}).b AS folded_root
  FROM r JOIN sub USING (tree) LEFT JOIN p ON p.tree = r.tree AND p.idx = r.idx)
SELECT *, folded_root = root AS verified FROM o""",
    "op13_leaks": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM t, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
found AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw USING (n, win)),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS at FROM found) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)""",
}
