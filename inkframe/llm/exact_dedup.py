"""Exact deduplication by a stream's keyed state.

A table is read as a stream of files. The stream's state holds one entry a text, keyed by the text's digest: how many rows
have it, and of the row that stays its stable identifier (``doc_id``) and its content locator (file and row in the file). Entries never expire and
lie in RocksDB, so on disk, with their change logs in the shared folder; a stream that is started again on the same folder goes on
where it ended, with new files only. Rows are counted per task before they travel, so the copies of one text cost one row a task.

A digest that was seen before is a hit, and only full bytes settle it: the text of every row that shares a digest is compared with the text at the
locator. Rows with other bytes under the same digest are grouped by their texts. Only texts whose digest may repeat travel: a
bitmap of the repeated digests, of ``BITS`` bits whatever the table's size, goes to all tasks. Digests that more than one row in ``SHARES`` has are
at most ``SHARES`` many; their rows are dealt out by locator and the entry is sent to each part.

All of it is DataFrame functions. Defined results: a null text is an empty one; texts are equal when they are identical, white space and
case included; of equal texts the row with the largest doc_id stays, a row without an id only where none has one, and of rows that share
that id the one that comes last by file and place; each row gives one row of the result, however often it is repeated; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .staging import Stage

#: Of the bitmap of repeated digests: 8 MB at most, one row for each 32,768 bits.
BITS = 1 << 26
#: A digest is dealt out if it has more than this part of all rows.
SHARES = 1_000
#: Bytes of files that one batch of the stream takes at least.
BATCH_BYTES = 64 << 30
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores takes megabytes of disk ahead
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
RESULT = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"
Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def located(docs: DataFrame, digest: Digest) -> DataFrame:
    """(digest, sha, id, file, row, text) of a table of files, batch or stream."""
    meta, text = docs.metadataColumn("_metadata"), F.coalesce(docs["text"], F.lit(""))
    return docs.select(digest(text).alias("digest"), sha256(text).alias("sha"), docs["doc_id"].cast("long").alias("id"), meta["file_path"].alias("file"), meta["row_index"].alias("row"), text.alias("text"))


def follow(docs: DataFrame, checkpoint: str, digest: Digest = sha256) -> StreamingQuery:
    """Start reading the stream ``docs`` into the state at ``checkpoint``; it ends when the files found now are read."""
    spark = docs.sparkSession
    rows = located(docs, digest)
    entry = rows.groupBy("digest").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("n"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:  # a query takes its settings when it is started
        return entry.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def entries(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, keep (id, file, row), n): the state as it is after the last batch."""
    return spark.read.format("statestore").load(checkpoint).select("key.digest", F.col("value.max").alias("keep"), F.col("value.count").alias("n"))


def _bit() -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(BITS))


def _may_repeat(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``rows``, their text null where no other row can have the digest."""
    marks = state.filter("n > 1").select(_bit().alias("bit"))
    bitmap = marks.groupBy(F.floor(F.col("bit") / 32768).alias("block")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("bit", _bit()).withColumn("block", F.floor(F.col("bit") / 32768)).join(F.broadcast(bitmap), "block", "left")
    hit = F.coalesce(F.getbit(byte, (F.col("bit") % 8).cast("int")) == 1, F.lit(False))
    return marked.withColumn("text", F.when(hit, F.col("text"))).drop("bit", "block", "bits")


def dedup(spark: SparkSession, path: str, digest: Digest = sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row for each row of the table of files at ``path``, as RESULT has it."""
    stage = Stage(spark, "exact-dedup")
    docs = spark.read.parquet(path)
    # a pattern, as a stream's path may be a file only if it is one
    stream = spark.readStream.schema(docs.schema).option("maxBytesPerTrigger", batch_bytes).parquet(f"{path[:-1]}[{path[-1]}]")
    query = follow(stream, f"{stage.root}/stream", digest)
    query.awaitTermination()
    if not query.recentProgress or not any(p["numInputRows"] for p in query.recentProgress):
        return spark.createDataFrame([], RESULT)
    state = stage.put("state", entries(spark, f"{stage.root}/stream"))
    total = state.agg(F.sum("n")).first()[0]
    share = max(1, total // SHARES)

    # of hot digests, at most SHARES, rows are dealt out and the entry is sent to each part
    parts = F.ceil(F.col("n") / share)
    hot = state.filter(F.col("n") > share).select("digest", parts.alias("parts"))
    salted = lambda df: df.join(F.broadcast(hot), "digest", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("file", "row"), "parts"), F.lit(0))).drop("parts")
    spread = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("n") > share, parts).otherwise(1) - 1)))
    rows = salted(_may_repeat(located(docs, digest), state)).join(spread(state), ["digest", "part"])
    own = F.struct("id", "file", "row").eqNullSafe(F.col("keep"))
    found = stage.put("found", rows.select("digest", "part", "sha", "id", "file", "row", "keep", "n", own.alias("kept"), F.when(F.col("n") > 1, F.col("text")).alias("text")))

    # hits: full bytes against the text at the locator
    hits = found.filter("n > 1")
    content = spread(hits.filter("kept").select("digest", "n", F.col("text").alias("content")))
    same = F.col("text") == F.col("content")
    checked = stage.put("checked", hits.join(content.drop("n"), ["digest", "part"]).select("digest", "sha", "id", "file", "row", "keep", "n", "kept", same.alias("same"), F.when(~same, F.col("text")).alias("text")))
    out = lambda df: df.select(F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))
    single = out(found.filter("n = 1"))
    others = checked.filter("not same")
    if others.isEmpty():
        equal = out(checked)
    else:  # digests that texts share which are not equal
        fewer = others.groupBy("digest").agg(F.count("*").alias("less"))
        first = checked.filter("same").join(fewer, "digest", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0)))
        by_text = others.groupBy("digest", "text").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count("*").alias("n"))
        rest = others.drop("keep", "n").join(by_text, ["digest", "text"]).withColumn("kept", own)
        equal = out(first).unionByName(out(rest))
    result = stage.put("result", single.unionByName(equal))
    stage.drop("stream", "state", "found", "checked")
    return result
