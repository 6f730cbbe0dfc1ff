"""The feedback log as a stream (an extension: the batch queries have the same results)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.feedback import windowed_counts
from ..sources.derived import read


def stream_folder(spark: SparkSession) -> str:
    """A new folder on the shared file system that the cluster names; a local one only where it names none, as in tests."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", "") or "file://" + tempfile.mkdtemp(prefix="inkframe-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"


def counted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by action from a stream over the events: late rows up to a day, duplicates dropped.

    Each batch appends the counts that it changed to a table, under the batch's number, so that neither the driver nor
    the state holds windows that are closed; the last count of each window stands. A batch that is tried again writes
    the same counts under the same number."""
    schema = read(spark, sf_dir, "events").schema
    # a stream reads folders or patterns: the bracket makes one of a path that may be a file or a folder
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    feedback = rows.select("event_id", F.col("ts").cast("timestamp").alias("saved_at"), F.when(F.col("event_type").isin("purchase", "signup"), "rejected").otherwise("corrected").alias("action"))
    fresh = feedback.withWatermark("saved_at", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    folder = stream_folder(spark)

    def keep(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{folder}/counts")

    job = windowed_counts(fresh).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    counts = spark.read.schema("win_start timestamp, action string, n long, batch int").parquet(f"{folder}/counts")
    return counts.groupBy("win_start", "action").agg(F.max_by("n", "batch").alias("n"))
