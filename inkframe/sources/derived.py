"""Glyph, expression, score and feedback tables derived from the TPC-H-like tables by integer arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import VOCABULARY


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task makes, about.
DEALT = 500_000


def dealt(rows: DataFrame, key: str, each: float = 1) -> DataFrame:
    """``rows`` dealt by ``key`` to as many tasks as they need when each becomes ``each`` rows.

    A small file is one task whatever its rows are made into, and Spark takes that for no larger than the file: without the hint, joins send
    whole tables of pixels through the driver."""
    return rows.repartition(tasks_for(rows.count() * each), key).hint("merge")


def tasks_for(rows: float) -> int:
    return max(1, math.ceil(rows / DEALT))


def vocabulary_at(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in VOCABULARY]), (index + 1).cast("int"))


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, glyph_id, x, y, w, h, conf, char)."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("image_id"), k.alias("glyph_id"), (k * 37 % 960).alias("x"), (40 + 70 * (k * 7 % 3) + k % 11).alias("y"),
        (10 + k * 13 % 40).alias("w"), (20 + k * 17 % 60).alias("h"), (k * 101 % 1000 / 1000.0).cast("double").alias("conf"), vocabulary_at(k % 16).alias("char"),
    )


def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, a, b, c, template, raw): ten forms of expression, some of them wrong."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", (k % 90 + 1).alias("a"), (k % 7).alias("b"), (k % 12 + 1).alias("c"), (k % 10).cast("int").alias("template"))
    forms = ["({a}+{b})*{c}", "{a}/{c}-{b}", "{c}({a}-{b})", "{a}/{b}", "+{a}", "{a}*", "(({a}", "{a}++{b}", "00{a}", "{a}+-{b}"]
    text = F.element_at(F.array(*[F.lit(f) for f in forms]), F.col("template") + 1)
    for name in "abc":
        text = F.replace(text, F.lit("{" + name + "}"), F.col(name).cast("string"))
    return rows.withColumn("raw", text)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, logits): the first 16 dimensions as class logits."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice("embedding", 1, 16).cast("array<double>").alias("logits"))


def binary_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, truth, pred)."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return read(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("truth"), (F.col("n_chars") >= 1000).cast("int").alias("pred"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, analysis_id, saved_at, action, label_idx, value)."""
    rows = read(spark, sf_dir, "events")
    return rows.select(
        "event_id", F.col("user_id").alias("analysis_id"), F.col("ts").cast("timestamp").alias("saved_at"),
        F.when(F.col("event_type").isin("purchase", "signup"), "rejected").otherwise("corrected").alias("action"),
        (F.get_json_object("props", "$.k").cast("long") % 16).alias("label_idx"), "value",
    )


def _pictures(spark: SparkSession, sf_dir: str, each: int) -> DataFrame:
    """(glyph_id) of the suppliers' pictures of about ``each`` pixels."""
    return dealt(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("glyph_id")), "glyph_id", each)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(glyph_id, y, x, v): 28 x 28 pictures for the suppliers' keys, by formula."""
    ids = _pictures(spark, sf_dir, 784)
    grid = ids.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(783))))
    y, x, g = F.floor(F.col("p") / 28), F.col("p") % 28, F.col("glyph_id")
    ink = (F.abs(x - 14) <= 2 + g % 5) & (y >= 3 + g % 4) & (y <= 24 - g % 3)
    return grid.select("glyph_id", y.cast("long").alias("y"), x.cast("long").alias("x"), F.when(ink, 100 + (x * 7 + y * 11 + g) % 150).otherwise((x + y + g) % 20).cast("long").alias("v"))


def photographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(glyph_id, y, x, v): ink maps of pages of some sizes for the suppliers' keys, by formula: strokes and ruled lines on uneven ground,
    every fourth one even and faint, every seventh one a screen of dots."""
    ids = _pictures(spark, sf_dir, 3_500)
    g, x, y = F.col("glyph_id"), F.col("x"), F.col("y")
    grid = ids.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), 41 + g % 3 * 7))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), 59 + g % 4 * 8)))
    stroke = (F.abs((x + g) % 23 - 9 - F.floor(y / 9)) <= 1 + g % 2) & (y > 6) & (y < 36) & ((x * 5 + y * 3 + g) % 17 != 0)
    ruled = (y % 19 == 17) & ((x + g) % 31 != 0)
    ground = F.when(g % 4 == 0, 12).otherwise(20 + F.floor(x * (2 + g % 3) / 2) + F.floor(y / 2)) + (x * 7 + y * 13 + g) % 6
    v = F.when(g % 7 == 1, F.when((x % 9 == 4) & (y % 9 == 4), 255).otherwise(0)).when(stroke, ground + F.when(g % 4 == 0, 25).otherwise(90) + (x * 3 + y) % 40).when(ruled, ground + 35).otherwise(ground)
    return grid.select("glyph_id", "y", "x", F.least(F.lit(255), v).cast("int").alias("v"))


def underlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(glyph_id, y, x, v): lines of characters on pages of some sizes for the suppliers' keys, by formula: rings, strokes and bars over an underline that
    touches them, lies apart, crosses the whole page or is absent, some joined to the next one, a second line on high pages, every eleventh page empty."""
    ids = _pictures(spark, sf_dir, 12_000)
    g, x, y = F.col("glyph_id"), F.col("x"), F.col("y")
    grid = ids.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), 47 + g % 3 * 26))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), 119 + g % 5 * 20)))
    row, cell, u = F.floor(y / 46), F.floor(x / 18), x % 18
    t, wide = y % 46, 6 + (g + cell) % 4
    top, base = 6 + (cell * 5 + g) % 5, 32
    low = base - F.when(g % 4 == 1, 4).otherwise(0)
    body = (u >= 4) & (u < 4 + wide) & (t >= top) & (t < low)
    ring = body & ((u < 6) | (u >= 2 + wide) | (t < top + 2) | ((t >= low - 5) & (t < low - 3)))
    shape = F.when(cell % 3 == 0, ring).when(cell % 3 == 1, body & (u >= 6) & (u < 10)).otherwise(body & ((t < top + 4) | (u >= 1 + wide)))
    bridge = ((cell + g) % 5 == 0) & (u >= 8) & (t >= top + 6) & (t < top + 8)
    line = (g % 4 != 3) & (((t == base) & ((x + g) % 37 != 0)) | (t == base + 1)) & F.when(g % 4 == 2, F.lit(True)).otherwise((x >= 8) & (x < 100 + g % 5 * 20))
    speck = (x * 31 + y * 17 + g * 7) % 997 == 0
    ink = (g % 11 != 5) & (((row == 0) | (g % 3 == 2)) & (shape | bridge | line) & (x < 112 + g % 5 * 20) | ((row == 0) & line) | speck)
    return grid.select("glyph_id", "y", "x", F.when(ink, 160 + (x * 7 + y * 11 + g) % 90).otherwise((x + y + g) % 20).cast("int").alias("v"))


#: The same tables as SQL, for the queries' SQL.
SQL = {
    "vocab": "vocab AS (SELECT unnest(['0','1','2','3','4','5','6','7','8','9','+','-','*','/','(',')']) AS char, unnest(range(16)) AS idx)",
    "glyphs": """glyphs AS (SELECT o_custkey AS image_id, o_orderkey AS glyph_id, (o_orderkey*37)%960 AS x, 40+70*((o_orderkey*7)%3)+o_orderkey%11 AS y,
  10+(o_orderkey*13)%40 AS w, 20+(o_orderkey*17)%60 AS h, (((o_orderkey*101)%1000)/1000.0)::DOUBLE AS conf,
  (['0','1','2','3','4','5','6','7','8','9','+','-','*','/','(',')'])[o_orderkey%16+1] AS char FROM orders)""",
    "exprs": """exprs AS (SELECT *, CASE template WHEN 0 THEN '('||a||'+'||b||')*'||c WHEN 1 THEN a||'/'||c||'-'||b WHEN 2 THEN c||'('||a||'-'||b||')'
  WHEN 3 THEN a||'/'||b WHEN 4 THEN '+'||a WHEN 5 THEN a||'*' WHEN 6 THEN '(('||a WHEN 7 THEN a||'++'||b WHEN 8 THEN '00'||a ELSE a||'+-'||b END AS raw
  FROM (SELECT o_orderkey, o_orderkey%90+1 AS a, o_orderkey%7 AS b, o_orderkey%12+1 AS c, (o_orderkey%10)::INT AS template FROM orders))""",
    "scores": "scores AS (SELECT vec_id, label, list_transform(embedding[1:16], lambda e: e::DOUBLE) AS logits FROM embeddings)",
    "binary_eval": "binary_eval AS (SELECT doc_id, quality AS truth, (n_chars >= 1000)::INT AS pred FROM labels JOIN documents USING (doc_id))",
    "feedback": """feedback AS (SELECT event_id, user_id AS analysis_id, ts AS saved_at, CASE WHEN event_type IN ('purchase','signup') THEN 'rejected' ELSE 'corrected' END AS action,
  CAST(json_extract_string(props, '$.k') AS BIGINT) % 16 AS label_idx, value FROM events)""",
    "pixels": """pixels AS (SELECT s_suppkey AS glyph_id, p//28 AS y, p%28 AS x,
  CASE WHEN abs(p%28-14) <= 2+s_suppkey%5 AND p//28 >= 3+s_suppkey%4 AND p//28 <= 24-s_suppkey%3 THEN 100+((p%28)*7+(p//28)*11+s_suppkey)%150 ELSE (p%28+p//28+s_suppkey)%20 END AS v
  FROM supplier, (SELECT unnest(range(784)) AS p))""",
    "underlined": """grid AS (SELECT s_suppkey AS g, y, x, y//46 AS rw, y%46 AS t, x//18 AS cell, x%18 AS u FROM supplier, range(100) r(y), range(200) c(x) WHERE y <= 47+s_suppkey%3*26 AND x <= 119+s_suppkey%5*20),
cells AS (SELECT *, 6+(g+cell)%4 AS wide, 6+(cell*5+g)%5 AS top, 32 AS base, 32-CASE WHEN g%4 = 1 THEN 4 ELSE 0 END AS low FROM grid),
bodies AS (SELECT *, u >= 4 AND u < 4+wide AND t >= top AND t < low AS body, g%4 != 3 AND ((t = base AND (x+g)%37 != 0) OR t = base+1) AND (g%4 = 2 OR (x >= 8 AND x < 100+g%5*20)) AS line FROM cells),
shapes AS (SELECT *, body AND CASE cell%3 WHEN 0 THEN u < 6 OR u >= 2+wide OR t < top+2 OR (t >= low-5 AND t < low-3) WHEN 1 THEN u >= 6 AND u < 10 ELSE t < top+4 OR u >= 1+wide END AS shape,
  (cell+g)%5 = 0 AND u >= 8 AND t >= top+6 AND t < top+8 AS bridge, (x*31+y*17+g*7)%997 = 0 AS speck FROM bodies),
underlined AS (SELECT g AS glyph_id, y, x, CASE WHEN g%11 != 5 AND (((rw = 0 OR g%3 = 2) AND (shape OR bridge OR line) AND x < 112+g%5*20) OR (rw = 0 AND line) OR speck) THEN 160+(x*7+y*11+g)%90 ELSE (x+y+g)%20 END AS v FROM shapes)""",
}


def with_(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
