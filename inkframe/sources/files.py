"""Files in and out: pictures, analysis records, the feedback log, the training log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import VOCABULARY, folder_label

CHARACTER = "id:string,char:string,conf:double,raw_char:string,raw_conf:double,top_k:array<struct<char:string,conf:double>>,rect:array<int>,adjusted:boolean,line_index:int,roi_path:string"
ANALYSIS = f"analysis_id string, created_at string, input_mode string, source_filename string, expression string, result string, error string, characters array<struct<{CHARACTER}>>"
FEEDBACK = "saved_at string, analysis_id string, source_filename string, character_id string, predicted_char string, corrected_char string, confidence double, raw_char string, raw_conf double, adjusted boolean, line_index int, rect array<int>, saved_image_path string, action string"
TRAINING_LOG = (
    "epoch int, loss double, accuracy double, val_loss double, val_accuracy double, macro_f1 double, macro_recall double, target_macro_f1 double, target_macro_recall double, "
    "boundary_macro_f1 double, boundary_macro_recall double, priority_score double, slash_f1 double, slash_recall double, star_f1 double, star_recall double"
)


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, data); files that are no pictures are left out."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def all_pictures(spark: SparkSession, path: str) -> DataFrame:
    """``pictures``, and an error if a file is none."""
    read = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    bad = F.raise_error(F.concat(F.lit("Could not read image: "), F.col("image.origin"))).cast("binary")
    data = F.when(F.col("image.height") <= 0, bad).otherwise(F.col("image.data"))
    return read.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), data.alias("data"))


def labelled_pictures(spark: SparkSession, path: str) -> DataFrame:
    """``pictures`` with the label that their folder names; unknown labels are left out."""
    label = folder_label(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1))
    return pictures(spark, path).withColumn("label", label).filter(F.col("label").isin(*VOCABULARY))


def analyses(spark: SparkSession, path: str) -> DataFrame:
    """Stored analysis records; a broken file is a row of nulls."""
    return spark.read.schema(ANALYSIS).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def write_analyses(records: DataFrame, path: str) -> None:
    """One folder per input mode, replaced."""
    records.write.mode("overwrite").partitionBy("input_mode").json(path)


def feedback_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK).json(path)


def append_feedback(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def training_log(spark: SparkSession, path: str, schema: str = TRAINING_LOG) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def data_uri(png):
    """A picture's bytes as text for a page; empty if there are none."""
    return F.when(F.coalesce(F.length(png), F.lit(0)) > 0, F.concat(F.lit("data:image/png;base64,"), F.base64(png))).otherwise("")


def analysis(spark: SparkSession, path: str, analysis_id: str) -> DataFrame:
    """The record of one analysis: no row if there is none."""
    return analyses(spark, path).filter(F.col("analysis_id") == analysis_id)


def append_training_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """One JSON row in place of the one before."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def class_names(summary: DataFrame, metadata: DataFrame, size: int | None = len(VOCABULARY)) -> DataFrame:
    """(class_names): those of the summary, else of the metadata; else the vocabulary if they are not ``size`` names.

    Both tables have one row or none with a list class_names."""
    ranked = summary.select("class_names", F.lit(0).alias("k")).unionByName(metadata.select("class_names", F.lit(1).alias("k"))).filter(F.size("class_names") > 0)
    best = ranked.agg(F.min_by("class_names", "k").alias("class_names"))
    fits = F.col("class_names").isNotNull() & (F.lit(size is None) | (F.size("class_names") == F.lit(size or 0)))
    return best.select(F.when(fits, F.col("class_names")).otherwise(F.array(*[F.lit(c) for c in VOCABULARY])).alias("class_names"))


def is_current(versions: DataFrame, wanted: str) -> DataFrame:
    """(current): whether a table of one version stamp or none has the wanted one."""
    return versions.agg(F.coalesce(F.max(F.trim("version") == wanted), F.lit(False)).alias("current"))
