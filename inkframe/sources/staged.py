"""Tables written to the cluster's shared folder, where a long plan is cut."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame


#: Rows of a staged table that a task takes, about: each of them may pass through a dozen sorts and groups, which hold them all at once.
TAKEN = 100_000


#: The same of a table of pixels, whose rows are small and soon counted.
PIXELS_TAKEN = 400_000


def tasks_of(table: DataFrame, taken: int | None = None) -> int:
    """How many tasks a staged ``table`` is dealt to: its rows are counted from its files' footers."""
    return max(1, math.ceil(table.count() / (taken or TAKEN)))


def staged(df: DataFrame, name: str, by: str | None = None, taken: int | None = None) -> DataFrame:
    """``df`` written under ``spark.checkpoint.dir`` and read back; the table goes when the driver ends. Given ``by``, it is dealt by that key to as many tasks as its
    rows need, so that what follows by this key stays there. Left alone, Spark sizes tasks by packed bytes, of which a few hold millions of runs.

    A lost executor costs what it was writing. Files of pixels and runs are packed far below what they hold, so Spark is asked not to
    send such a table through the driver. Only where that setting is absent is a folder of this machine taken."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", "") or "file://" + tempfile.mkdtemp(prefix="inkframe-")
    place = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(place)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    table = spark.read.schema(df.schema).parquet(place)
    return (table.repartition(tasks_of(table, taken), by) if by else table).hint("merge")
