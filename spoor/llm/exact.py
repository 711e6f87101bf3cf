"""Exact deduplication with keyed streaming state on disk.

The rows' digests, identifiers and content locators form an arrival log. A
Structured Streaming aggregation keyed by digest reads the log in bounded
micro-batches; its state lives in RocksDB, is checkpointed to the shared folder
and never expires. Per digest the state retains how many rows arrived, the
largest identifier and the locator of that row's content: a digest of its
file's path and its row number in the file, by which ``content`` fetches it. The final state is
read back as a table. Hits (digests with more than one row) are then compared
by their full bytes: all texts of a digest are equal if and only if the least
and the greatest are. A digest whose texts differ is regrouped by the text
itself.

Defined results: null text counts as empty and all empty texts are equal; of
equal texts the row with the largest doc_id stays (null ids are lowest); of
repeated rows with that id exactly one stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, packed, text_of, unpacked, work_path, written

_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",  # an executor's, for all its stores
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside for their logs
}


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed_state(log_path: str, schema, spark, checkpoint: str, max_bytes_per_trigger: int = 4 << 30) -> DataFrame:
    """Run the log through the keyed state until it is read up; return the state as (digest, n_rows, keep).

    A second call with the same checkpoint reads only what the log has gained.
    """
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes_per_trigger)).parquet(log_path)
        state = stream.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"), F.max("entry").alias("keep"))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    kept = spark.read.format("statestore").load(checkpoint)
    n_rows, keep = (f"value.`{name}`" for name in kept.schema["value"].dataType.names)
    return kept.select(F.col("key.digest").alias("digest"), F.expr(n_rows).alias("n_rows"), F.expr(keep).alias("keep"))


def file_place(docs: DataFrame) -> Column:
    """Where a row's content is: a digest of its file's path and its row number in the file; null where ``docs`` does not come from files."""
    place = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
    try:
        docs.select(place)
    except AnalysisException:
        return F.lit(None).cast("string")
    return place


def content(docs: DataFrame, located: DataFrame, locator: Column | None = None) -> DataFrame:
    """(locator, text) of the rows of ``docs`` that the locators of ``located`` (keep_locator) name."""
    wanted = located.select(F.col("keep_locator").alias("wanted")).distinct()
    rows = docs.select((file_place(docs) if locator is None else locator.cast("string")).alias("locator"), text_of().alias("text"))
    return rows.join(wanted, F.col("locator") == F.col("wanted"), "left_semi")


def groups(docs: DataFrame, digest=sha256_text, locator: Column | None = None, max_bytes_per_trigger: int = 4 << 30) -> DataFrame:
    """Every row of ``docs`` with its group: doc_id, digest, seq, keep_id, keep_seq, group_size, kept, locator.

    ``digest`` maps the text column to the state's key; equality never rests on
    it, as hits are checked by full bytes. ``locator`` says where a row's
    content is; by default its place in the files (null where ``docs`` does not
    come from files).
    """
    spark = docs.sparkSession
    log = work_path(spark, "exact-log")
    text = text_of()
    place = file_place(docs) if locator is None else locator.cast("string")
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest(text).alias("digest"), place.alias("locator"))
    read = read.withColumn("seq", F.monotonically_increasing_id()).select("digest", F.struct("doc_id", "seq", "locator").alias("entry"))
    read.write.parquet(log)
    arrived = spark.read.schema(read.schema).parquet(log)
    state = written(keyed_state(log, read.schema, spark, work_path(spark, "exact-state"), max_bytes_per_trigger), "exact-groups")

    hits = state.filter("n_rows > 1").select(F.col("digest").alias("hit"))
    texts = docs.select(text.alias("text"), digest(text).alias("digest"))
    differ = written(
        texts.join(broadcast_if_small(hits), F.col("digest") == F.col("hit")).groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select("digest"), "exact-differ"
    )
    found = arrived.join(state.select("digest", "n_rows", "keep"), "digest")
    out = found.select("digest", "entry", F.col("n_rows").alias("group_size"), "keep")
    if not differ.isEmpty():
        # The digest is shared by different texts: group those rows by the text itself.
        entries = arrived.join(differ, "digest", "left_semi").select(F.col("digest").alias("d"), "entry")
        again = docs.select(F.col("doc_id").cast("bigint").alias("id"), text.alias("text"), digest(text).alias("digest")).join(differ, "digest", "left_semi")
        # Rows of one id and digest pair with their texts in any order; only their number matters.
        by_text = again.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"))
        ids = again.groupBy("digest", "text", "id").agg(F.count(F.lit(1)).alias("times")).join(by_text, ["digest", "text"])
        order = Window.partitionBy("digest", "id")
        ids = ids.withColumn("upto", F.sum("times").over(order.orderBy("text"))).select("digest", "id", "n", "keep_id", (F.col("upto") - F.col("times")).alias("from"), "upto", "text")
        numbered = entries.withColumn("at", F.row_number().over(Window.partitionBy("d", "entry.doc_id").orderBy("entry.seq")) - 1)
        exact = numbered.join(ids, (F.col("d") == F.col("digest")) & F.col("entry.doc_id").eqNullSafe(F.col("id")) & (F.col("at") >= F.col("from")) & (F.col("at") < F.col("upto")))
        chosen = exact.groupBy("digest", "text").agg(F.max("entry").alias("keep"))
        exact = exact.join(chosen, ["digest", "text"]).select("digest", "entry", F.col("n").alias("group_size"), "keep")
        out = out.join(differ, "digest", "left_anti").unionByName(exact)
    return out.select(
        F.col("entry.doc_id").alias("doc_id"), "digest", F.col("entry.seq").alias("seq"), F.col("keep.doc_id").alias("keep_id"), F.col("keep.seq").alias("keep_seq"),
        F.col("group_size").cast("bigint").alias("group_size"), (F.col("entry.seq") == F.col("keep.seq")).alias("kept"), F.col("keep.locator").alias("keep_locator"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    marked = written(groups(docs), "exact-marked")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    key = [F.col("doc_id").alias("kid"), F.col("digest").alias("kdigest")]
    gone = marked.filter(~stays).select(*key).distinct()
    repeated = marked.filter(stays).groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(*key)
    rows = packed(docs, rid=F.col("doc_id").cast("bigint"), rdigest=sha256_text(text_of()))
    same = F.col("rid").eqNullSafe(F.col("kid")) & (F.col("rdigest") == F.col("kdigest"))
    found = rows.join(broadcast_if_small(written(gone, "exact-gone")), same, "left_anti")
    if not (repeated := written(repeated, "exact-repeated")).isEmpty():  # one id and one text more than once: one of the rows stays
        found = found.join(repeated, same, "left_anti").unionByName(found.join(repeated, same, "left_semi").dropDuplicates(["rid", "rdigest"]))
    return unpacked(found, docs)
