"""Corrections and rejections: look-up, validation, last write, conflicts, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import VOCABULARY, label_token, normal_label
from ..sources.derived import vocabulary_at


def lookup(feedback: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Feedback with its label's character; the vocabulary has 16 rows."""
    return feedback.join(F.broadcast(vocabulary), feedback["label_idx"] == vocabulary["idx"], "left").select("event_id", "analysis_id", "action", "char")


def last_writes(feedback: DataFrame) -> DataFrame:
    """Of each analysis and label the last correction; rejections stay as they are."""
    order = Window.partitionBy("analysis_id", "label_idx").orderBy(F.desc("saved_at"), F.desc("event_id"))
    last = feedback.filter("action = 'corrected'").withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")
    return last.unionByName(feedback.filter("action = 'rejected'"))


def conflicts(feedback: DataFrame) -> DataFrame:
    """(analysis_id, label_idx) both corrected and rejected."""
    keys = lambda action: feedback.filter(F.col("action") == action).select("analysis_id", "label_idx")
    return keys("corrected").intersect(keys("rejected"))


def messages(feedback: DataFrame) -> DataFrame:
    """What an analysis's author is told."""
    some = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))
    c, r = F.col("n_corrected"), F.col("n_rejected")
    counts = feedback.groupBy("analysis_id").agg(F.count_if(F.col("action") == "corrected").alias("n_corrected"), F.count_if(F.col("action") == "rejected").alias("n_rejected"))
    text = F.when((c > 0) & (r > 0), F.concat(F.lit("Saved "), some(c, "correction"), F.lit(" and "), some(r, "rejection"), F.lit("."))).when(c > 0, F.concat(F.lit("Saved "), some(c, "correction"), F.lit("."))).otherwise(F.concat(F.lit("Saved "), some(r, "rejection"), F.lit(".")))
    return counts.select("analysis_id", text.alias("message"))


def confidence_summary(glyphs: DataFrame) -> DataFrame:
    """Per image: average confidence in percent, rounded half up, and how many are below 0.8.

    A picture's confidences are added in the order of its glyphs: at a half, the order decides where a sum of doubles falls, and partial sums would follow the files' parts."""
    whole = Window.partitionBy("image_id").orderBy("glyph_id", "conf").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mean = glyphs.withColumn("mean", F.avg("conf").over(whole))
    return mean.groupBy("image_id").agg(F.floor(F.first("mean") * 100 + 0.5).cast("long").alias("avg_percent"), F.count_if(F.col("conf") < 0.8).alias("n_low"))


def topk_text(rows: DataFrame) -> DataFrame:
    """Per item the ranked characters as ``a 40% · b 20%``, through JSON and back."""
    g = rows.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("rank", "char", "conf"))).alias("k"))
    back = F.from_json(F.to_json("k"), "array<struct<rank:int,char:string,conf:double>>")
    return g.select("vec_id", F.array_join(F.transform(back, lambda t: F.concat(t["char"], F.lit(" "), F.floor(t["conf"] * 100 + 0.5).cast("string"), F.lit("%"))), " · ").alias("summary"))


def windowed_counts(feedback: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts by action in tumbling windows; also the body of the streaming job."""
    return feedback.groupBy(F.window("saved_at", width).alias("win"), "action").agg(F.count("*").alias("n")).select(F.col("win.start").alias("win_start"), "action", "n")


def labels_used(feedback: DataFrame) -> DataFrame:
    return feedback.select(vocabulary_at(F.col("label_idx")).alias("char")).distinct()


def pending(characters: DataFrame) -> DataFrame:
    """Characters (char, corrected_char, rejected) with an open correction or rejection, and which."""
    changed = (F.coalesce("corrected_char", F.lit("")) != "") & ~F.col("corrected_char").eqNullSafe(F.col("char"))
    kind = F.when(F.coalesce("rejected", F.lit(False)), "rejected").when(changed, "corrected")
    return characters.withColumn("pending", kind).filter("pending is not null")


def validated(items: DataFrame, characters: DataFrame, analyses: DataFrame) -> DataFrame:
    """(analysis_id, error): why a request can't be saved; null if it can.

    items: (analysis_id, ord, action, character_id, corrected_char), in the request's order. Corrections are looked at
    before rejections, the first item that fails decides; a character must not be in both."""
    own = items.withColumns({"character_id": F.trim(F.coalesce("character_id", F.lit(""))), "label": normal_label(F.col("corrected_char")), "correction": F.col("action") == "corrected"})
    known = characters.select("analysis_id", F.col("character_id"), F.lit(True).alias("is_known"))
    met = own.join(known, ["analysis_id", "character_id"], "left")
    what = F.when(F.col("correction"), "A correction").otherwise("A rejection")
    bad = (
        F.when(F.col("character_id") == "", F.concat(what, F.lit(" is missing character_id.")))
        .when(F.col("correction") & ~F.col("label").isin(*VOCABULARY), F.concat(F.lit("Unsupported correction label: "), F.when(F.col("label") == "", "(empty)").otherwise(F.col("label"))))
        .when(F.col("is_known").isNull(), F.concat(F.lit("Unknown character_id: "), F.col("character_id")))
    )
    seen = met.withColumn("bad", bad)
    first = seen.filter("bad is not null").groupBy("analysis_id").agg(F.min_by("bad", F.struct(~F.col("correction"), "ord")).alias("first"))
    both = seen.groupBy("analysis_id", "character_id").agg(F.count_if("correction").alias("c"), F.count_if(~F.col("correction")).alias("r")).filter("c > 0 and r > 0").select("analysis_id").distinct()
    asked = own.select("analysis_id").distinct()
    out = asked.join(analyses.select("analysis_id", F.lit(True).alias("stored")), "analysis_id", "left").join(first, "analysis_id", "left").join(both.withColumn("both", F.lit(True)), "analysis_id", "left")
    error = (
        F.when(F.col("stored").isNull(), "The selected analysis could not be found.").when(F.col("first").isNotNull(), F.col("first"))
        .when(F.col("both"), "A character cannot be corrected and rejected at the same time.")
    )
    return out.select("analysis_id", error.alias("error"))


def entries(items: DataFrame, characters: DataFrame, analyses: DataFrame, saved_at: Column) -> DataFrame:
    """Log entries of the requests that can be saved: of corrections of one character the last, rejections all.

    characters: (analysis_id, character_id, char, conf, raw_char, raw_conf, adjusted, line_index, x, y, w, h);
    analyses: (analysis_id, source_filename)."""
    good = validated(items, characters, analyses).filter("error is null").select("analysis_id")
    own = items.join(good, "analysis_id").withColumn("character_id", F.trim("character_id"))
    latest = F.row_number().over(Window.partitionBy("analysis_id", "character_id", "action").orderBy(F.desc("ord")))
    own = own.withColumn("k", latest).filter("k = 1 or action = 'rejected'").join(characters, ["analysis_id", "character_id"]).join(analyses, "analysis_id")
    said, label = label_token(F.col("char")), normal_label(F.col("corrected_char"))
    stem = F.concat(F.col("analysis_id").cast("string"), F.lit("_"), F.col("character_id"), F.lit("_pred-"), said)
    correction = F.col("action") == "corrected"
    path = F.when(correction, F.concat(F.lit("corrections/"), label_token(label), F.lit("/"), stem, F.lit("_label-"), label_token(label), F.lit(".png"))).otherwise(
        F.concat(F.lit("rejections/pred_"), said, F.lit("/"), stem, F.lit("_rejected.png")))
    return own.select(
        utc_iso(saved_at).alias("saved_at"), "analysis_id", "source_filename", "character_id", F.col("char").alias("predicted_char"), F.when(correction, label).alias("corrected_char"),
        F.bround("conf", 3).alias("confidence"), "raw_char", F.bround("raw_conf", 3).alias("raw_conf"), "adjusted", "line_index", F.array("x", "y", "w", "h").alias("rect"), path.alias("saved_image_path"), "action", "ord")


def reports(entries_: DataFrame) -> DataFrame:
    """A row a saved request: its corrections and rejections in order, and the message."""
    one = F.struct("ord", "character_id", "predicted_char", "corrected_char", "confidence", "saved_image_path")
    some = lambda action: F.sort_array(F.collect_list(F.when(F.col("action") == action, one)))
    return entries_.groupBy("analysis_id", "source_filename").agg(some("corrected").alias("corrections"), some("rejected").alias("rejections")).join(messages(entries_), "analysis_id")


def utc_iso(at: Column) -> Column:
    """A time as text in UTC, with fractions only where there are some."""
    utc = F.to_utc_timestamp(at, F.current_timezone())
    micro = F.date_format(utc, "SSSSSS")
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micro != "000000", F.concat(F.lit("."), micro)).otherwise(""), F.lit("Z"))


def analysis_id(at: Column, random: Column) -> Column:
    """A name for an analysis: its second in UTC and eight hexadecimal digits of ``random``, a uuid."""
    return F.concat(F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMdd'T'HHmmss"), F.lit("_"), F.substring(F.replace(random, F.lit("-"), F.lit("")), 1, 8))
