"""Lines of glyphs: clusters around a moving centre, scores, the dual reading of doubtful glyphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let


def cluster(glyphs: DataFrame, floor: float, ratio: float) -> DataFrame:
    """(image_id, glyph_id, line): glyphs from top to bottom join the first line whose mean centre is
    near enough, else open one. The centre moves with each glyph, so an image is one fold."""
    g = glyphs.groupBy("image_id").agg(
        F.sort_array(F.collect_list(F.struct((F.col("y") + F.col("h") / 2.0).cast("double").alias("cy"), F.col("glyph_id").cast("long").alias("glyph_id")))).alias("c"), F.greatest(F.lit(floor), F.median("h") * ratio).alias("near"))

    def put(lines: Column, c: Column) -> Column:
        fits = lambda k: F.coalesce(F.abs(c["cy"] - F.try_element_at(lines, k)["total"] / F.size(F.try_element_at(lines, k)["ids"])) <= F.col("near"), F.lit(False))
        at = F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), fits), F.lit(1))
        new = F.struct(c["cy"].alias("total"), F.array(c["glyph_id"]).alias("ids"))
        joined = lambda at: F.transform(lines, lambda t, k: F.when(k + 1 == at, F.struct((t["total"] + c["cy"]).alias("total"), F.concat(t["ids"], F.array(c["glyph_id"])).alias("ids"))).otherwise(t))
        return let([at], lambda at: F.when(at.isNull(), F.concat(lines, F.array(new))).otherwise(joined(at)))

    lines = F.aggregate("c", F.array().cast("array<struct<total:double,ids:array<bigint>>>"), put)
    rows = g.select("image_id", F.posexplode(F.transform(lines, lambda t: t["ids"])).alias("line", "ids"))
    return rows.select("image_id", F.explode("ids").alias("glyph_id"), F.col("line").cast("long").alias("line"))


def line_scores(lined: DataFrame, area: str | None = None) -> DataFrame:
    """(image_id, line, score): digits, parentheses and operators count for a line; lone operators against it.

    ``area``: a column with the line's area, else the sum over its boxes."""
    digit, op, paren = (F.count_if(F.col("char").rlike(p)) for p in ("^[0-9]$", "^[-+*/]$", "^[()]$"))
    g = lined.groupBy("image_id", "line").agg(
        F.count("*").alias("n"), digit.alias("d"), op.alias("o"), paren.alias("p"), F.avg("conf").alias("c"), (F.first(area) if area else F.sum(F.col("w") * F.col("h"))).alias("area"),
        ((F.max(F.col("x") + F.col("w")) - F.min("x")) / F.greatest(F.lit(1.0), (F.max(F.col("y") + F.col("h")) - F.min("y")).cast("double"))).alias("aspect"))
    from pyspark.sql import Window

    best = F.max("area").over(Window.partitionBy("image_id"))
    # The weights of a line's score
    n, d, o, p = (F.col(c) for c in ("n", "d", "o", "p"))
    few = (n <= 2) & (o >= 1) & (d + p <= 1)
    less = lambda test, k: F.when(test, k).otherwise(0.0)
    score = (
        d * 5.0 + p * 2.5 + o * 1.5 + n * 1.4 + F.col("c") * 2.5 + F.least(F.lit(3.0), F.col("area") / F.greatest(F.lit(1.0), best.cast("double")) * 3.0)
        - less((n == 1) & (o == 1), 10.0) - less((n <= 2) & (d == 0), 8.0) - less(few, 5.0) - less((F.col("aspect") >= 8) & (o >= 1) & (d + p <= 1), 8.0) - less((d == 0) & (o > 0) & (p == 0), 4.0))
    return g.withColumn("score", score).select("image_id", "line", "n", "score")


def shape_hint(aspect: Column, symmetry: Column, density: Column) -> Column:
    """``operator`` where the shape alone says so, else null."""
    return F.when((aspect >= 2.5) | (aspect.between(0.65, 1.55) & (symmetry >= 0.55) & (density >= 0.55)), "operator")


def dual_reading(rows: DataFrame) -> DataFrame:
    """``rows`` (char, conf, aspect, symmetry, density, top) with read and read_conf: a digit against its
    shape loses confidence, and a doubtful 1, -, 7 or / is decided by its shape."""
    # Bounds of the shapes, and what a digit against its shape keeps of its confidence
    char, a = F.col("char"), F.col("aspect")
    conf = F.when(char.rlike("^[0-9]$") & (shape_hint(a, F.col("symmetry"), F.col("density")) == "operator"), F.col("conf") * 0.60).otherwise(F.col("conf"))
    one = F.when((a >= 2.0) & (F.col("symmetry") >= 0.60), "-").when((a < 0.8) & (F.col("density") >= 0.60), "1").otherwise("-")
    seven = F.when(F.col("top") >= 0.10, "7").when(a >= 1.8, "/").otherwise("7")
    read = F.when(F.col("read_conf") >= 0.75, char).when(char.isin("1", "-"), one).when(char.isin("7", "/"), seven).otherwise(char)
    return rows.withColumn("read_conf", conf).withColumn("read", read)
