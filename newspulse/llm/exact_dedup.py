"""Exact deduplication over a stream with keyed state on disk.

The state, a RocksDB store per partition without expiry, holds for every
digest the row that stays: its id and the place of its content (file and row
number), and how many rows have come. Rows whose digest is known are compared
with that content byte by byte before they count as copies.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newspulse.session import scratch_path, settle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State settings for the stream: on disk, memory bounded for all stores of an executor.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # A finished task closes its store; the shared checkpoint has the state.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


def digest_of(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def keyed_state(spark, path: str, digest=digest_of, files_per_batch: int | None = None) -> DataFrame:
    """(digest, kept, seen) of all rows below ``path`` (parquet with doc_id, text).

    ``kept`` is the struct (doc_id, file, row) of the row with the largest id,
    the later place among equal ids. A stopped stream resumes from its
    checkpoint; every micro-batch writes the keys it changed, and the last
    entry of a key holds, as counts only grow.
    """
    source = spark.readStream.schema("doc_id long, text string")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    text = F.coalesce("text", F.lit(""))
    # As a pattern, so that the path of one file is accepted as well as a folder's.
    keyed = source.parquet(f"{path[:-1]}[{path[-1]}]").select(
        digest(text).alias("digest"),
        F.struct("doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"),
    ).groupBy("digest").agg(F.max("place").alias("kept"), F.count(F.lit(1)).alias("seen"))
    out, before = scratch_path(spark, "dedup-state"), {k: spark.conf.get(k, None) for k in STATE}

    def note(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/keys/batch={batch}")

    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = keyed.writeStream.outputMode("update").foreachBatch(note).option(
            "checkpointLocation", f"{out}/checkpoint-{uuid.uuid4().hex}").trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest string, kept struct<doc_id:long,file:string,row:long>, seen long, batch int"
    spark.createDataFrame([], schema).drop("batch").write.mode("append").parquet(f"{out}/keys/batch=-1")
    keys = spark.read.schema(schema).parquet(f"{out}/keys")
    if not files_per_batch:
        return keys.select("digest", "kept", "seen")
    return keys.groupBy("digest").agg(F.max_by("kept", "batch").alias("kept"), F.max("seen").alias("seen"))


def groups(spark, path: str, digest=digest_of, files_per_batch: int | None = None) -> DataFrame:
    """One row per row below ``path``: its place, the place that is kept, group_size, text_sha256, stays.

    A digest with one row needs no check. The others read their texts again
    and are compared with the text kept under the digest; that join has one
    row per digest on one side, so a hot group splits. Rows that differ from
    it (a collision) form groups by their full text. A null id is smaller
    than any other.
    """
    text = F.coalesce("text", F.lit(""))
    state = settle(
        keyed_state(spark, path, digest, files_per_batch).select(
            "digest", "seen", F.col("kept.doc_id").alias("keep_id"), F.col("kept.file").alias("keep_file"),
            F.col("kept.row").alias("keep_row")), "dedup-keys")
    rows = spark.read.schema("doc_id long, text string").parquet(path).select(
        "doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
        text.alias("text"), digest(text).alias("digest"), digest_of(text).alias("text_sha256"))
    place = ["doc_id", "file", "row", "text_sha256"]
    keep = ["keep_id", "keep_file", "keep_row"]
    at_keep = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    single = rows.drop("text").join(state.where(F.col("seen") == 1), "digest").select(
        *place, *keep, F.lit(1).cast("long").alias("group_size"))
    copies = settle(rows.join(state.where(F.col("seen") > 1), "digest"), "dedup-copies")
    held = copies.where(at_keep).select(F.col("digest").alias("d"), F.col("text").alias("held_text"))
    other = F.when(F.col("text") != F.col("held_text"), F.col("text"))
    checked = settle(
        copies.join(held, F.col("digest") == F.col("d")).select(*place, *keep, "digest", "seen", other.alias("other")),
        "dedup-checked")
    others = checked.where(F.col("other").isNotNull())
    best = F.max(F.struct("doc_id", "file", "row"))
    by_text = others.groupBy("digest", "other").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    lost = others.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    same = checked.where(F.col("other").isNull()).join(lost, "digest", "left").select(
        *place, *keep, (F.col("seen") - F.coalesce("lost", F.lit(0))).alias("group_size"))
    apart = others.drop(*keep).join(by_text, ["digest", "other"]).select(
        *place, F.col("best.doc_id").alias("keep_id"), F.col("best.file").alias("keep_file"),
        F.col("best.row").alias("keep_row"), "group_size")
    return single.unionByName(same).unionByName(apart).withColumn("stays", at_keep)


def dedup(spark, path: str, **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (null counts as empty) the row with the largest id stays;
    rows that repeat an id and its text are all marked as kept, as they can't
    be told apart by id. An empty table gives no rows.
    """
    return groups(spark, path, **options).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(spark, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, one for each text, with all their columns.

    The rows are written once to the shared folder, as a stream reads files.
    Of repeated rows (same id, same text) one stays.
    """
    path = scratch_path(spark, "dedup-input")
    docs.write.parquet(path)
    stays = groups(spark, path).where("stays").select(F.col("file").alias("__file"), F.col("row").alias("__row"))
    rows = spark.read.schema(docs.schema).parquet(path)
    marked = rows.select("*", F.col("_metadata.file_path").alias("__at"), F.col("_metadata.row_index").alias("__no"))
    return marked.join(stays, (F.col("__at") == F.col("__file")) & (F.col("__no") == F.col("__row")), "left_semi").drop("__at", "__no")
