"""Predictions against what was expected: lengths, characters by place, whole cases, stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import expressions as X
from . import halves
from . import refinement as R


def length_status(wanted: Column, got: Column) -> Column:
    """struct(status, issue) of a reading with ``got`` characters where ``wanted`` were written."""
    return (
        F.when(got == wanted, F.struct(F.lit("OK_length").alias("status"), F.lit(None).cast("string").alias("issue")))
        .when(got < wanted, F.struct(F.lit("UNDER_SEGMENT").alias("status"), F.lit("Missing characters (characters touching or strokes lost)").alias("issue")))
        .otherwise(F.struct(F.lit("OVER_SEGMENT").alias("status"), F.lit("Extra characters (noise, broken box, or over-splitting)").alias("issue")))
    )


def segmentation_report(boxes: DataFrame, cases: DataFrame) -> DataFrame:
    """A row a case (image_id, true_expr): lengths, status and mean box sizes (0 without boxes)."""
    found = boxes.groupBy("image_id").agg(F.count("*").alias("n"), F.avg("w").alias("mw"), F.avg("h").alias("mh"))
    n = F.coalesce(F.col("n"), F.lit(0))
    own = cases.join(found, "image_id", "left").withColumns({"true_length": F.length("true_expr"), "pred_length": n.cast("int")})
    return own.withColumn("s", length_status(F.col("true_length"), F.col("pred_length"))).select(
        "image_id", "true_length", "pred_length", (F.col("pred_length") - F.col("true_length")).alias("length_diff"), "s.status", "s.issue",
        F.coalesce("mw", F.lit(0.0)).alias("mean_rect_width"), F.coalesce("mh", F.lit(0.0)).alias("mean_rect_height"))


def zipped(*lists: DataFrame) -> DataFrame:
    """Rows (image_id, place, ...) of all lists that have one at the same place, so that the shortest list decides."""
    out = lists[0]
    for other in lists[1:]:
        out = out.join(other, ["image_id", "place"])
    return out


def by_place(predicted: DataFrame, expected: DataFrame) -> DataFrame:
    """(n, n_correct, accuracy in percent) of characters by place; places without an expected one count as wrong."""
    hit = F.coalesce((F.col("char") == F.col("expected")).cast("long"), F.lit(0))
    got = predicted.join(expected, ["image_id", "place"], "left").agg(F.count("*").alias("n"), F.coalesce(F.sum(hit), F.lit(0)).alias("n_correct"))
    return got.withColumn("accuracy", F.coalesce(F.try_divide(F.col("n_correct") * 100.0, "n"), F.lit(0.0)))


def read_lines(lines: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, expression, result, error) for every one of ``images``; one without lines has an error.

    lines: (image_id, tokens)."""
    e = X.evaluate(lines)
    one = lambda c: F.when(F.count("*") == 1, F.first(c))
    own = X.line_summary(e).join(e.groupBy("image_id").agg(one("error").alias("error")), "image_id")
    own = own.withColumn("known", F.lit(True))
    return images.join(own, "image_id", "left").select(
        "image_id", F.coalesce("expression", F.lit("")).alias("expression"), "result",
        F.when(F.col("known"), F.col("error")).otherwise("No valid expression lines were produced.").alias("error"))


def expected_results(cases: DataFrame) -> DataFrame:
    """``cases`` (expected_expression) with expected_result and why a case can't serve, null where it can."""
    e = X.evaluate(cases.withColumn("tokens", F.split("expected_expression", "")))
    changed = F.col("expression") != F.col("expected_expression")
    unfit = F.when(F.col("error").isNotNull(), F.concat(F.lit("invalid: "), F.col("error"))).when(changed, F.concat(F.lit("normalized to "), F.col("expression")))
    return e.withColumn("unfit", unfit).withColumn("expected_result", F.when(F.col("unfit").isNull(), F.col("result"))).drop("tokens", "expression", "result", "error")


def replayed(cases: DataFrame, records: DataFrame) -> DataFrame:
    """Cases (name, analysis_id, expected_expression) with what their stored records (analysis_id, tokens, n_lines) give.

    A case without a record fails the query, as does one that can't serve; records of several lines have no one expression."""
    e = X.evaluate(records)
    several = F.col("n_lines") != 1
    got = e.select(
        "analysis_id", F.when(several, "Detected multiple lines").otherwise(F.col("expression")).alias("pred_expr"), F.when(~several, F.col("result")).alias("pred_result"),
        F.when(several, "Expected a single expression line.").otherwise(F.col("error")).alias("pred_error"), F.lit(True).alias("known"))
    own = expected_results(cases).join(got, "analysis_id", "left")
    missing = F.raise_error(F.concat(F.lit("Missing analysis record: "), F.col("analysis_id").cast("string")))
    own = own.withColumn("pred_expr", F.when(F.col("known").isNull(), missing.cast("string")).when(F.col("unfit").isNotNull(), F.raise_error(F.col("unfit")).cast("string")).otherwise(F.col("pred_expr")))
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return own.withColumns({"expr_match": same("pred_expr", "expected_expression"), "result_match": same("pred_result", "expected_result")}).drop("known", "unfit")


def replayed_glyphs(cases: DataFrame, glyphs: DataFrame, pictures: DataFrame | None = None) -> DataFrame:
    """``replayed`` of records whose raw glyphs (analysis_id, item) are refined into lines first.

    pictures (analysis_id, place, y, x, v): the glyphs' own, on which halves are measured. A record of which no line is left has, like one of several, no one expression."""
    items = glyphs.select(F.col("analysis_id").alias("image_id"), "item")
    lines = R.refine_images(items) if pictures is None else halves.refine_pictures(items, pictures.withColumnRenamed("analysis_id", "image_id"))
    read = lines.groupBy(F.col("image_id").alias("analysis_id")).agg(F.count("*").cast("int").alias("n_lines"), F.first(F.transform("items", lambda g: g["char"])).alias("tokens"))
    known = glyphs.select("analysis_id").distinct().join(read, "analysis_id", "left")
    return replayed(cases, known.select("analysis_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), F.coalesce("n_lines", F.lit(0)).alias("n_lines")))


def case_totals(cases: DataFrame) -> DataFrame:
    """One row of a replay: how many cases, and how many right; 0 without cases."""
    share = lambda c: F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0))
    return cases.agg(
        F.count("*").alias("total_cases"), F.count_if("expr_match").alias("expression_correct"), F.count_if("result_match").alias("result_correct"),
        share("expr_match").alias("expression_accuracy"), share("result_match").alias("result_accuracy"))
