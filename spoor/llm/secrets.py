"""Secret scans with an incremental blob ledger, DataFrame operations only.

Every version of every path is content-addressed by SHA-256. The ledger is an
append-only Parquet folder with one row a scan: blob, the rule versions that
ran, and what they found. A run asks the ledger by digest which blobs lack
which rule versions, and only then fetches those blobs' texts, so a second run
over the same paths moves digests only. Findings join back to all paths of the
blob.

A rule's matches are its regular expression's, leftmost and non-overlapping,
less those too short; start and end are code points, end exclusive. They come
from the lengths of the matches and of the pieces between them. Three rules are
the base; others add spans of known key formats.

Defined results: null text counts as empty and has no findings; repeated rows
give repeated rows; an empty table gives no rows; overlapping matches of
different rules all count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, text_of, work_path, written
from .exact import sha256_text
from ..plans.components import join_by_key


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; every match holds ``hint``; a changed rule needs a new version."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# Fixed values. The lower bounds of access and hex stand in the pattern: runs are taken whole, so the matches are the same.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0, "PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, "xox"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0, 30, "eyJ"),
    Rule("google", 1, r"AIza[0-9A-Za-z_-]{35,}", 0, 39, "AIza"),
)
RULES = BASE + MORE
_FOUND = "array<struct<rule:string,gap:int,len:int,holds:boolean>>"


def _matches(text: Column, rule: Rule) -> Column:
    """For each match of the rule, in order: characters since the match before, its own, and whether it is long enough."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    rows = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("match"), part.alias("part"))
    told = F.transform(rows, lambda z: F.struct(F.lit(rule.name).alias("rule"), F.length(z["gap"]).alias("gap"), F.length(z["match"]).alias("len"), (F.length(z["part"]) >= rule.least).alias("holds")))
    some = F.size(whole) > 0 if rule.hint is None else text.contains(rule.hint) & (F.size(whole) > 0)
    return F.when(some, told).otherwise(F.array().cast(_FOUND))


def scan(docs: DataFrame, ledger: str, rules=RULES) -> int:
    """Scan the texts of ``docs`` for the rule versions that the ledger lacks, append the findings, and return how many (blob, rule) pairs were scanned."""
    spark, text = docs.sparkSession, text_of()
    names = F.array(*[F.lit(r.name) for r in rules])
    blobs = docs.select(sha256_text(text).alias("blob"), text.alias("text"))
    known, before = read_ledger(spark, ledger), 0
    if known is None:
        todo = blobs.dropDuplicates(["blob"]).withColumn("rules", names)
    else:
        before = _pairs(known)
        seen = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        lacks = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))
        # Digests only; texts are fetched for what is left.
        open_ = join_by_key(blobs.select("blob").distinct(), seen, "blob", "left").select(F.col("blob").alias("open"), lacks.alias("rules")).filter(F.size("rules") > 0)
        open_ = written(open_, "secret-open")
        if open_.isEmpty():
            return 0
        todo = blobs.join(broadcast_if_small(open_), F.col("blob") == F.col("open")).dropDuplicates(["blob"])
    found = F.concat(*[F.when(F.array_contains("rules", r.name), _matches(F.col("text"), r)).otherwise(F.array().cast(_FOUND)) for r in rules])
    todo.select("blob", "rules", found.alias("found")).write.mode("append").parquet(ledger)
    return _pairs(read_ledger(spark, ledger)) - before


def _pairs(ledger: DataFrame) -> int:
    return ledger.agg(F.coalesce(F.sum(F.size("rules")), F.lit(0))).first()[0]


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"blob string, rules array<string>, found {_FOUND}").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules=RULES) -> DataFrame:
    """(blob, kind, rank, start, end) of every match that holds, for the given rule versions."""
    rows = read_ledger(spark, ledger).filter(F.size("found") > 0).select("blob", F.posexplode("found").alias("at", "f")).select("blob", "at", "f.*")
    upto = Window.partitionBy("blob", "rule").orderBy("at")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))
    ranks = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.name), F.lit(k))])
    return rows.withColumn("rank", ranks[F.col("rule")]).filter("holds and rank is not null").select("blob", F.split("rule", "@")[0].alias("kind"), "rank", "start", "end")


def scan_paths(docs: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """One row a document: doc_id, blob, spans (array of kind, start, end, by start and rule)."""
    spark = docs.sparkSession
    ledger = ledger or work_path(spark, "secret-ledger")
    text = text_of()
    scan(docs, ledger, rules)
    spans = findings(spark, ledger, rules).groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))
    paths = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), sha256_text(text).alias("blob"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return join_by_key(paths, spans, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))
