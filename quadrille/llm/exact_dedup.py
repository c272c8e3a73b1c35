"""Exact deduplication as a stateful stream, in DataFrame operations only.

A ledger of (digest, identifier, content locator) goes through a Structured Streaming aggregation whose
state (RocksDB on disk, checkpointed, without watermark and so without expiry) holds one entry a digest:
how many texts had it, and the identifier and locator of the one that stays. Map-side partial
aggregation makes one row of each task's copies, so a hot text is no hot key. On hits (digests with more
than one row) the full bytes are compared: the least and the greatest text of a digest must be one text;
a digest for which they differ is keyed by its full text instead.

Defined results: null counts as the empty text; texts are equal when their UTF-8 bytes are; of equal
texts the largest id stays; rows that repeat an id are counted each, and all rows of the id that stays
are marked as kept (keep_one leaves one of them). An empty table gives no rows. A null id is less than all others: a text that only rows without
an id hold has keep_id null. kept is null for rows without an id, as in SQL; keep_one leaves them out
unless null_ids is set, which keeps those whose text no row with an id holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import fresh_path, small, written

#: Rows of an id and a digest that are sent to all executors, at most.
FEW = 200_000


def ledger(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(digest, id, size, locator): the locator is the file that holds the row; with the id it finds the content."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.sha2(text.cast("binary"), 256).alias("digest"), F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("size"), F.input_file_name().alias("locator"))


def absorb(arrivals: DataFrame, state: str) -> DataFrame:
    """Runs a stream of ledger rows into the state at a shared folder and gives the digests as they stand: [digest, group_size, keep_id, locator].

    arrivals is a streaming DataFrame. Called again with the same state and more arrivals, it goes on from there.
    """
    spark = arrivals.sparkSession
    now = arrivals.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "locator")).alias("stays"))
    out = f"{state}/standing"

    def write(batch: DataFrame, number: int) -> None:
        batch.select("digest", "group_size", F.col("stays.id").alias("keep_id"), F.col("stays.locator").alias("locator")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = now.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    kind = arrivals.schema["id"].dataType.simpleString()
    schema = f"digest string, group_size bigint, keep_id {kind}, locator string"
    if query.lastProgress is None:  # no row arrived
        return spark.createDataFrame([], schema)
    standing = spark.read.schema(f"{schema}, batch bigint").parquet(out)
    if max(p["batchId"] for p in query.recentProgress) == 0:
        return standing.drop("batch")
    last = F.max_by(F.struct("group_size", "keep_id", "locator"), "batch").alias("s")
    return standing.groupBy("digest").agg(last).select("digest", "s.*")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """[id, digest, keep_id, group_size, kept] of every row."""
    spark = docs.sparkSession
    state = fresh_path(spark, "dedup")
    rows = ledger(docs, id_col, text_col)
    rows.write.parquet(f"{state}/ledger")
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200", "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        standing = absorb(spark.readStream.schema(rows.schema).parquet(f"{state}/ledger"), state)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    hits = standing.where("group_size > 1").select("digest")
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.sha2(text.cast("binary"), 256).alias("digest"), F.col(id_col).alias("id"), text.alias("text"))
    # Few hits (checked) go to the texts; else both are shuffled, and a hot digest is split. The least and greatest texts combine before they shuffle.
    few = hits.limit(FEW + 1).count() <= FEW
    differ = written(texts.join(F.broadcast(hits) if few else hits, "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("digest"), "collisions")
    every = spark.read.schema(rows.schema).parquet(f"{state}/ledger").select("digest", F.col("id").alias("own_id"))
    plain = every.join(standing.select("digest", "keep_id", "group_size"), "digest")
    out = plain.select("own_id", "digest", "keep_id", "group_size", (F.col("own_id") == F.col("keep_id")).alias("kept"))
    if not differ.isEmpty():
        by_text = texts.join(F.broadcast(differ) if differ.limit(FEW + 1).count() <= FEW else differ, "digest", "left_semi")
        each = by_text.groupBy("digest", "text").agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id"))
        exact = by_text.join(each, ["digest", "text"]).select(F.col("id").alias("own_id"), "digest", "keep_id", "group_size", (F.col("id") == F.col("keep_id")).alias("kept"))
        out = out.join(differ, "digest", "left_anti").select(*exact.columns).unionByName(exact)
    return out.withColumnRenamed("own_id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", null_ids: bool = False) -> DataFrame:
    """docs without the copies: of each text one row whose id stays, with all its columns (of rows alike in id and text the least by all columns); with null_ids also one row of a text that no row with an id holds."""
    found = duplicates(docs, id_col, text_col)
    kept = F.col(id_col).eqNullSafe(F.col("keep_id")) if null_ids else F.coalesce("kept", F.lit(False))
    keys = found.select(F.col(id_col).alias("__id"), F.unhex("digest").alias("__digest"), kept.alias("__kept"))
    judged = written(keys.groupBy("__id", "__digest", "__kept").agg(F.count("*").alias("__rows")).where("not __kept or __rows > 1"), "judged")
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))

    def matched(keys: DataFrame, how: str) -> DataFrame:
        return docs.join(small(keys.select("__id", "__digest"), FEW), F.col(id_col).eqNullSafe(F.col("__id")) & (digest == F.col("__digest")), how)

    rest, several = matched(judged, "left_anti"), judged.where("__kept")
    if several.isEmpty():
        return rest
    one = matched(several, "left_semi").groupBy(F.col(id_col).alias("__id"), digest.alias("__digest")).agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return rest.unionByName(one)
