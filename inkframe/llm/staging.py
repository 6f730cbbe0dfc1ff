"""Tables that cut lineage: written to the cluster's shared folder, read back, dropped when done.

A staged table survives lost executors, because it lies in the folder named by
``spark.checkpoint.dir`` and not on one machine. Only where that setting is absent (tests,
a laptop) does this module choose a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: While a table is written: delete its shuffle files after, and keep Arrow batches of long texts small.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", "")
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    own = spark.conf.get("inkframe.shared.dir", "")
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="inkframe-")
        spark.conf.set("inkframe.shared.dir", own)
    return own


class Stage:
    """A folder of one job's staged tables; ``drop`` removes tables that no later step reads, and the folder goes with the driver."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex[:12]}"
        fs, path = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, place: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def put(self, name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and return the written table. Its shuffle files go as soon as it is written."""
        path = f"{self.root}/{name}"
        before = {k: self.spark.conf.get(k) for k in WHILE_WRITING}
        for k, v in WHILE_WRITING.items():
            self.spark.conf.set(k, v)
        try:
            fresh = df.select("*")  # the clean-up mode is fixed when a Dataset is made
            writer = fresh.write.option("compression", "zstd")
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._at(f"{self.root}/{name}")
            fs.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
