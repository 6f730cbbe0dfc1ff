"""Queries over glyphs with measures: shape rules, decision lists and whole lines read as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import shapes as S
from ..operators import evaluation, halves
from ..operators import refinement as R
from ..sources import derived as D
from .registry import query

#: Measures of nine shapes, around which the test glyphs lie: ( ) / - * 1, a sparse 7, a bracket, and none of these.
TEMPLATES = {
    "aspect": (0.4, 0.4, 0.8, 3.0, 1.0, 0.45, 0.45, 0.35, 0.9), "fill": (0.4, 0.4, 0.28, 0.5, 0.55, 0.4, 0.14, 0.45, 0.4), "left": (0.6, 0.3, 0.3, 0.4, 0.4, 0.42, 0.2, 0.7, 0.4), "right": (0.3, 0.6, 0.3, 0.4, 0.4, 0.4, 0.2, 0.28, 0.5),
    "top": (0.4, 0.4, 0.4, 0.4, 0.4, 0.4, 0.24, 0.4, 0.3), "bottom": (0.4, 0.4, 0.4, 0.4, 0.4, 0.4, 0.02, 0.4, 0.5), "center": (0.42, 0.42, 0.5, 0.6, 0.85, 0.6, 0.03, 0.08, 0.3), "center_row": (0.5, 0.5, 0.25, 0.8, 0.5, 0.4, 0.2, 0.3, 0.3),
    "center_col": (0.5, 0.5, 0.3, 0.4, 0.5, 0.6, 0.12, 0.3, 0.3), "diag_primary": (0.5, 0.5, 0.12, 0.5, 1.25, 0.5, 0.3, 0.6, 0.6), "diag_secondary": (0.5, 0.5, 1.02, 0.5, 1.25, 0.5, 0.3, 0.5, 0.6),
}
STEPS = {m: 7 + 6 * i for i, m in enumerate(TEMPLATES)}
_MEASURED = ", ".join(f"(([{', '.join(map(str, v))}])[k%9+1] + ((k*{STEPS[m]})%11-5)/50.0)::DOUBLE AS \"{m}\"" for m, v in TEMPLATES.items())
_V = "(['0','1','2','3','4','5','6','7','8','9','+','-','*','/','(',')'])"
_GLYPHS = f"""WITH ks AS (SELECT o_custkey AS image_id, o_orderkey AS k FROM orders),
g AS (SELECT image_id, k AS glyph_id, k*37%960 AS x, k%23 AS y, 4+k*13%40 AS w, 6+k*17%60 AS h, {_V}[(k*5)%16+1] AS char, (k*101%1000/1000.0)::DOUBLE AS conf, {_V}[(k*7)%16+1] AS raw_char, (k*53%1000/1000.0)::DOUBLE AS raw_conf, {_MEASURED},
 (CASE WHEN k%9 = 8 THEN k%4 ELSE 0 END)::DOUBLE AS holes, (CASE WHEN k%9 = 3 THEN 3+k%5 ELSE 12+k%12 END)::DOUBLE AS content_h, (5+k%14)::DOUBLE AS content_w,
 CASE WHEN k%5 = 0 THEN [] ELSE [{{'char': '/', 'conf': (k*11%100/100.0)::DOUBLE}}, {{'char': {_V}[k%16+1], 'conf': (k*29%100/100.0)::DOUBLE}}, {{'char': '(', 'conf': (k*17%30/100.0)::DOUBLE}}] END AS top_k FROM ks),
r0 AS (SELECT *, diag_secondary - diag_primary AS m, greatest("left", "right", 1e-6) / greatest(least("left", "right"), 1e-6) AS bal FROM g),
r1 AS (SELECT *, aspect >= 2.0 AND content_h <= 6 AND center_row >= 0.45 AS minus,
 holes = 0 AND content_h >= 12 AND aspect <= 1.05 AND fill <= 0.42 AND center <= 0.78 AND center_col <= 0.52 AND diag_secondary >= 0.72 AND m >= 0.42 AS slash,
 holes = 0 AND fill BETWEEN 0.15 AND 0.30 AND center BETWEEN 0.42 AND 0.62 AND center_row <= 0.30 AND center_col <= 0.32 AND diag_secondary >= 0.72 AND m >= 0.62 AND diag_primary <= 0.12 AS slash_fragment,
 holes = 0 AND content_h >= 14 AND aspect <= 0.65 AND fill BETWEEN 0.25 AND 0.78 AND center >= 0.35 AND center_row >= 0.42 AND center_col BETWEEN 0.42 AND 0.90 AND "left" >= "right"*1.35 AS left_paren,
 holes = 0 AND content_h >= 14 AND aspect <= 0.65 AND fill BETWEEN 0.25 AND 0.78 AND center >= 0.35 AND center_row >= 0.42 AND center_col BETWEEN 0.42 AND 0.90 AND "right" >= "left"*1.35 AS right_paren,
 holes = 0 AND content_h >= 14 AND aspect <= 0.42 AND fill BETWEEN 0.24 AND 0.72 AND center <= 0.12 AND center_row <= 0.38 AND center_col <= 0.36 AND top >= 0.22 AND bottom >= 0.22 AND "left" >= "right"*2.10 AS open_bracket,
 holes = 0 AND content_h >= 14 AND aspect <= 0.40 AND fill BETWEEN 0.34 AND 0.62 AND center <= 0.36 AND center_row <= 0.43 AND center_col <= 0.55 AND top >= 0.34 AND bottom >= 0.34 AND "left" >= "right"*1.75 AS drawn_open,
 holes = 0 AND content_h >= 14 AND aspect <= 0.42 AND fill BETWEEN 0.24 AND 0.72 AND center <= 0.12 AND center_row <= 0.38 AND center_col >= 0.48 AND top >= 0.22 AND bottom >= 0.22 AND "right" >= "left"*2.10 AS close_bracket,
 holes = 0 AND aspect BETWEEN 0.75 AND 1.2 AND fill >= 0.45 AND center >= 0.75 AND diag_primary >= 1.15 AND diag_secondary >= 1.15 AND abs(m) <= 0.2 AS star,
 holes = 0 AND content_h >= 14 AND aspect <= 0.9 AND fill >= 0.28 AND center >= 0.45 AND center_col >= 0.5 AND content_w >= 6 AND bal <= 2.1 AS straight_one,
 holes = 0 AND content_h >= 18 AND aspect <= 0.60 AND fill BETWEEN 0.20 AND 0.46 AND center BETWEEN 0.24 AND 0.72 AND center_row >= 0.30 AND center_col <= 0.40 AND content_w <= 12 AND bal >= 1.65 AND abs(m) >= 0.55 AS slanted_one,
 holes <= 1 AND aspect BETWEEN 0.70 AND 1.00 AND center <= 0.18 AND center_row >= 0.16 AND center_col <= 0.24 AND "right" >= "left"*1.25 AND bottom >= top*0.95 AS three,
 holes = 0 AND aspect BETWEEN 0.30 AND 0.58 AND fill BETWEEN 0.08 AND 0.20 AND top >= 0.18 AND bottom <= 0.06 AND center <= 0.06 AND center_col <= 0.22 AS sparse_seven,
 aspect BETWEEN 0.65 AND 1.0 AND fill <= 0.36 AND center <= 0.70 AND center_col <= 0.40 AND center_row <= 0.58 AND diag_secondary >= 0.82 AND m >= 0.52 AND holes = 0 AND content_h >= 12 AS sure_slash,
 aspect BETWEEN 0.72 AND 0.9 AND holes = 0 AND fill <= 0.31 AND center <= 0.57 AND center_row <= 0.30 AND center_col <= 0.36 AND diag_secondary >= 0.94 AND m >= 0.68 AS strong_slash,
 holes = 0 AND aspect BETWEEN 0.30 AND 0.55 AND fill <= 0.32 AND center_row <= 0.34 AND center_col <= 0.36 AND abs("left"-"right") <= 0.08 AND diag_secondary >= 1.00 AND m >= 0.75 AS thin_slash FROM r0),
sh AS (SELECT *, left_paren OR open_bracket OR drawn_open AS open_boundary, right_paren OR close_bracket AS close_boundary, straight_one OR slanted_one AS one FROM r1),
tk AS (SELECT glyph_id, max(t.conf) AS best, max(t.conf) FILTER (t.char = '/') AS c_slash, arg_min(t.conf, i) FILTER (t.char = '*') AS c_star, arg_min(t.conf, i) FILTER (t.char = '1') AS c_one, arg_min(t.conf, i) FILTER (t.char = '(') AS c_open, arg_min(t.conf, i) FILTER (t.char = ')') AS c_close, arg_min(t.conf, i) FILTER (t.char = '/') AS f_slash
 FROM (SELECT glyph_id, unnest(top_k) AS t, generate_subscripts(top_k, 1) AS i FROM g) GROUP BY glyph_id),
su AS (SELECT sh.*, len(top_k) = 0 AS bare, coalesce(f_slash, 0) AS slash_k, len(top_k) > 0 AND (raw_char = '/' OR (coalesce(f_slash, 0) >= 0.25 AND best-coalesce(f_slash, 0) <= 0.08)) AS slash_near, len(top_k) > 0 AND (raw_char = '*' OR (coalesce(c_star, 0) >= 0.25 AND best-coalesce(c_star, 0) <= 0.20)) AS star_near,
 CASE WHEN len(top_k) = 0 THEN char = '1' ELSE raw_char = '1' OR (coalesce(c_one, 0) >= 0.18 AND best-coalesce(c_one, 0) <= 0.16) END AS one_near, len(top_k) = 0 OR raw_char = '(' OR coalesce(c_open, 0) >= 0.07 AS open_ok, len(top_k) = 0 OR raw_char = ')' OR coalesce(c_close, 0) >= 0.08 AS close_ok,
 CASE WHEN len(top_k) = 0 THEN CASE WHEN raw_char = '/' THEN raw_conf ELSE 0 END ELSE coalesce(f_slash, 0) END AS slash_listed, lag(char) OVER o AS pv, lead(char) OVER o AS nx, median(w*h) OVER i AS ma, median(h) OVER i AS mh FROM sh LEFT JOIN tk USING (glyph_id) WINDOW o AS (PARTITION BY image_id ORDER BY x, glyph_id), i AS (PARTITION BY image_id))"""


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, glyph_id, x, y, w, h, char, conf, raw_char, raw_conf, measures, top_k)."""
    k = F.col("o_orderkey")
    share = lambda m, n=100: (k * m % n / 100.0).cast("double")
    near = {m: (F.element_at(F.array(*[F.lit(v) for v in values]), (k % 9 + 1).cast("int")) + (k * STEPS[m] % 11 - 5) / 50.0).cast("double") for m, values in TEMPLATES.items()}
    entry = lambda c, p: F.struct(c.alias("char"), p.alias("conf"))
    top = F.array(entry(F.lit("/"), share(11)), entry(D.vocabulary_at(k % 16), share(29)), entry(F.lit("("), share(17, 30)))
    # a glyph's lists and folds cost as much as some tens of plain rows
    return D.dealt(D.read(spark, sf_dir, "orders"), "o_custkey", 25).select(
        F.col("o_custkey").alias("image_id"), k.alias("glyph_id"), (k * 37 % 960).alias("x"), (k % 23).alias("y"), (4 + k * 13 % 40).alias("w"), (6 + k * 17 % 60).alias("h"), D.vocabulary_at(k * 5 % 16).alias("char"), (k * 101 % 1000 / 1000.0).cast("double").alias("conf"),
        D.vocabulary_at(k * 7 % 16).alias("raw_char"), (k * 53 % 1000 / 1000.0).cast("double").alias("raw_conf"), *[v.alias(m) for m, v in near.items()], F.when(k % 9 == 8, k % 4).otherwise(0).cast("double").alias("holes"),
        F.when(k % 9 == 3, 3 + k % 5).otherwise(12 + k % 12).cast("double").alias("content_h"), (5 + k % 14).cast("double").alias("content_w"), F.when(k % 5 == 0, F.array().cast("array<struct<char:string,conf:double>>")).otherwise(top).alias("top_k"))


def _items(spark, sf_dir) -> DataFrame:
    """Glyphs as structs with their neighbours' characters and their image's medians."""
    g = _glyphs(spark, sf_dir)
    order, image = Window.partitionBy("image_id").orderBy("x", "glyph_id"), Window.partitionBy("image_id")
    own = {c: F.col(c) for c in g.columns} | {"place": F.row_number().over(order)}
    g = g.withColumns({"place": own["place"], "before": F.lag("char").over(order), "after": F.lead("char").over(order), "ma": F.median(F.col("w") * F.col("h")).over(image), "mh": F.median("h").over(image)})
    return g.select("image_id", "glyph_id", "before", "after", "ma", "mh", R.glyph(own | {"place": F.col("place")}).alias("g"))


_RULES = [*S.RULES, *S.UNIONS]


@query(_GLYPHS + " " + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER ({n}) AS n FROM sh" for n in _RULES))
def shape_rules(spark, sf_dir):
    counts = _glyphs(spark, sf_dir).agg(*[F.count_if(S.looks_like(n)).alias(n) for n in _RULES])
    return counts.unpivot([], _RULES, "rule", "n")


@query(_GLYPHS + """ SELECT glyph_id, NOT (char = '-' AND conf >= 0.95 AND minus AND w >= greatest(10, mh*0.16)) AND ((conf < 0.55 AND w*h < greatest(25, ma*0.1)) OR (w*h < greatest(120, ma*0.02) AND h < greatest(14, mh*0.2)) OR (content_h < 5 AND conf < 0.98)
  OR (char = '-' AND conf < 0.995 AND w*h < greatest(32, ma*0.22) AND h < greatest(10, mh*0.35))) AS noise,
 w*h <= greatest(180, ma*0.32) AND h <= greatest(32, mh*0.46) AND (char IN ('+','-','*','/','(',')') OR minus OR slash) AS edge, h <= greatest(84, mh*0.92) AND (raw_char IN ('1','7','/','(',')') OR w <= greatest(36, mh*0.40) OR aspect <= 0.42) AS half,
 (char = '*' AND conf >= 0.9) OR (char IN ('+','4') AND conf >= 0.9 AND star) OR (char = '-' AND conf >= 0.98 AND minus) OR (char = '/' AND conf >= 0.8 AND slash) OR (char IN ('1','7') AND (strong_slash OR (conf < 0.995 AND sure_slash))) AS strong,
 CASE WHEN holes >= 2 THEN '8' WHEN holes = 1 THEN CASE WHEN "right" >= "left"*1.15 AND center >= 0.14 THEN '9' WHEN "left" >= "right"*1.15 AND center <= 0.12 THEN '6' ELSE '0' END
  WHEN aspect BETWEEN 0.34 AND 0.60 AND "right" >= "left"*1.60 AND center <= 0.16 AND center_col <= 0.15 AND diag_primary >= diag_secondary*2.20 THEN '9' END AS pair FROM su""")
def glyph_tests(spark, sf_dir):
    """Specks, fragments at a number's ends, halves of digits, sure operators, and the digit that two halves may make up."""
    i, g = _items(spark, sf_dir), F.col("g")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return i.select("glyph_id", flag(R.is_noise(g, F.col("ma"), F.col("mh"))).alias("noise"), R.edge_fragment(g, F.col("ma"), F.col("mh")).alias("edge"), R.is_half(g, F.col("mh")).alias("half"), R.strong_operator(g).alias("strong"), R.pair_char(g["f"]).alias("pair"))


_NUMBER = """CASE WHEN char IN ('/','(',')') AND one AND NOT (open_boundary OR close_boundary) THEN '1' WHEN char = '-' AND sparse_seven THEN '7'
 WHEN char = '7' AND holes = 0 AND aspect <= 0.55 AND "right" >= "left"*1.8 AND center >= 0.35 AND center_row >= 0.28 AND center_col <= 0.35 THEN '1'
 WHEN char = '1' AND holes = 0 AND aspect <= 0.55 AND "left" >= "right"*2.2 AND center <= 0.10 AND center_col <= 0.30 AND bottom >= top*0.9 THEN '6' WHEN char IN ('7','2') AND three THEN '3'
 WHEN char = '5' AND holes = 0 AND aspect >= 0.68 AND "left" >= "right"*1.35 AND top <= 0.24 AND bottom >= top*1.75 AND center >= 0.24 AND center_col <= 0.36 THEN '6' WHEN char = '6' AND "left" >= "right"*1.08 THEN '6' WHEN char = '9' AND "right" >= "left"*1.08 THEN '9'
 WHEN holes >= 2 THEN '8' WHEN char IN ('7','0',')') AND holes = 1 AND center >= 0.18 AND "right" >= "left"*1.2 AND top >= bottom*0.95 THEN '9' WHEN char = '/' AND holes = 0 AND aspect <= 0.62 AND content_w <= 10 THEN '1'
 WHEN char = '/' AND aspect >= 0.75 THEN CASE WHEN bottom > top*1.12 THEN '2' ELSE '3' END WHEN char IN ('(',')','6') AND "left" >= "right"*1.15 THEN '6' WHEN char IN ('(',')','6') AND "right" >= "left"*1.15 AND center >= 0.18 THEN '9' ELSE char END"""
_BETWEEN = "coalesce(regexp_full_match(pv, '[0-9)]') AND regexp_full_match(nx, '[0-9(]'), false)"
_EXPR = f"""CASE WHEN char IN ('1','/','(',')') AND one AND NOT open_boundary AND NOT close_boundary AND NOT slash THEN '1'
 WHEN char = '+' AND {_BETWEEN} AND star_near AND center >= 0.48 AND diag_primary >= 0.52 AND diag_secondary >= 0.52 AND abs(diag_primary-diag_secondary) <= 0.32 THEN '*'
 WHEN char IN ('1','7','-','(',')') AND slash AND {_BETWEEN} AND NOT one THEN '/' WHEN char IN ('4','*','+') AND star AND {_BETWEEN} THEN '*' WHEN char IN ('/','(',')') AND slash AND {_BETWEEN} THEN '/' WHEN char IN ('1','7','/','(',')') AND slash AND slash_near AND {_BETWEEN} THEN '/'
 WHEN char IN ('1','7','(',')') AND (thin_slash OR strong_slash OR (conf < 0.995 AND sure_slash)) AND {_BETWEEN} THEN '/'
 WHEN char IN ('(',')','1','/') AND open_boundary AND NOT one AND open_ok AND (pv IS NULL OR pv IN ('+','-','*','/','(')) AND coalesce(regexp_full_match(nx, '[0-9(-]'), false) THEN '('
 WHEN char IN ('(',')','1','7','/') AND close_boundary AND NOT one AND close_ok AND coalesce(regexp_full_match(pv, '[0-9)]'), false) AND (nx IS NULL OR nx IN ('+','-','*','/',')')) THEN ')' ELSE char END"""


@query(_GLYPHS + f" SELECT glyph_id, {_NUMBER} AS as_number, {_EXPR} AS as_expression FROM su")
def glyph_decisions(spark, sf_dir):
    """What each glyph is in a number, and in an expression between its neighbours' own characters."""
    g = F.col("g")
    return _items(spark, sf_dir).select("glyph_id", R.number_char(g).alias("as_number"), R.expression_char(g, F.col("before"), F.col("after")).alias("as_expression"))


_BEST = lambda plain, close: f"CASE WHEN slash_near THEN greatest({plain}, {close}) ELSE {plain} END"
_IN = lambda chars, a, b: f"CASE WHEN char IN ({', '.join(repr(c) for c in chars)}) THEN {a} ELSE {b} END"


@query(_GLYPHS + f""", ca AS (SELECT glyph_id, char, conf + 0.55::DOUBLE AS score FROM su UNION ALL SELECT glyph_id, '-', 0.84 FROM su WHERE minus UNION ALL SELECT glyph_id, '*', {_IN('*+4', .90, .86)} FROM su WHERE star
 UNION ALL SELECT glyph_id, '/', CASE WHEN strong_slash THEN {_BEST(_IN('17/)(', .98, .92), _IN('17/', 1.02, .94))} WHEN sure_slash THEN {_BEST(_IN('17/)(', .92, .86), _IN('17/', .98, .90))} WHEN slash_near THEN {_IN('17/', 1.0, .90)} WHEN slash_listed >= 0.10 THEN greatest(0.80, 0.72::DOUBLE+slash_listed) ELSE 0.80 END FROM su WHERE strong_slash OR sure_slash OR slash
 UNION ALL SELECT glyph_id, '(', {_IN('()1/6', .83, .78)} FROM su WHERE open_boundary AND NOT one AND open_ok UNION ALL SELECT glyph_id, ')', {_IN('()1/7', .83, .78)} FROM su WHERE close_boundary AND NOT one AND close_ok
 UNION ALL SELECT glyph_id, '1', CASE WHEN one_near THEN greatest({_IN('1/()', .87, .80)}, {_IN('/()', .96, .90)}) ELSE {_IN('1/()', .87, .80)} END FROM su WHERE one AND NOT (open_boundary OR close_boundary))
SELECT glyph_id, char, round(max(score), 6) AS score FROM ca GROUP BY ALL""")
def glyph_candidates(spark, sf_dir):
    """What each glyph may be, with the best score of each class."""
    c = _items(spark, sf_dir).select("glyph_id", F.explode(R.candidates(F.col("g"))).alias("c"))
    return c.groupBy("glyph_id", F.col("c.char").alias("char")).agg(F.round(F.max("c.score"), 6).alias("score"))


@query()
def refined_lines(spark, sf_dir):
    """The lines of each image's glyphs, read as numbers and expressions."""
    items = _items(spark, sf_dir).select("image_id", F.col("g").alias("item"))
    lines = R.refine_images(items)
    return lines.select("image_id", "line", F.array_join(F.transform("items", lambda g: g["char"]), "").alias("expression"), "numeric", "score", F.size(F.filter("items", lambda g: g["adjusted"])).alias("n_adjusted"))


@query()
def replayed_glyphs(spark, sf_dir):
    """Each image's glyphs refined and read again, against a sum for its key."""
    glyphs = _items(spark, sf_dir).select(F.col("image_id").alias("analysis_id"), F.col("g").alias("item"))
    k = F.col("analysis_id")
    cases = glyphs.select("analysis_id").distinct().withColumn("expected_expression", F.concat((k % 9 + 1).cast("string"), F.lit("+"), (k % 7 + 1).cast("string")))
    columns = ("expected_expression", "expected_result", "pred_expr", "pred_result", "pred_error", "expr_match", "result_match")
    return evaluation.replayed_glyphs(cases, glyphs).select("analysis_id", *columns)


def halves_and_pictures(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Glyphs (image_id, place, x, y, w, h), closer to one another than in other queries, and their pictures (image_id, place, y, x, v) of other
    sizes than their boxes: rings, halves of rings to both sides, strokes with a bar, and every thirteenth one empty."""
    k = F.col("glyph_id")
    g = _glyphs(spark, sf_dir).select("image_id", k.cast("int").alias("place"), (k * 37 % 150).alias("x"), "y", (4 + k * 13 % 24).alias("w"), (12 + k * 17 % 50).alias("h"))
    c, pw, ph = F.col("place"), 5 + F.col("place") % 6, 7 + F.col("place") % 7
    every = lambda n: F.sequence(F.lit(0), n - 1)
    dots = g.select("image_id", "place", pw.alias("pw"), ph.alias("ph"), F.explode(every(ph)).alias("y")).withColumn("x", F.explode(every(F.col("pw"))))
    u, v, kind = F.col("x"), F.col("y"), c % 4
    rim = (v == 1) | (v == F.col("ph") - 1)
    left, right = (kind != 1) & (u == 0), (kind != 0) & (u == F.col("pw") - 1)
    ink = F.when(kind == 3, (u == F.floor(F.col("pw") / 2)) | (v == 3)).otherwise((v >= 1) & (rim | left | right)) & (c % 13 != 0)
    return g, dots.select("image_id", "place", "y", "x", F.when(ink, 255).otherwise(0).alias("v"))


@query()
def pasted_halves(spark, sf_dir):
    """Glyphs that may be halves of one digit: the digit that both make up as one picture, and its measures."""
    glyphs, pictures = halves_and_pictures(spark, sf_dir)
    f = F.col("f")
    return halves.together(glyphs, pictures).select("image_id", "left", "right", R.pair_char(f).alias("char"), *[F.round(f[m], 6).alias(m) for m in ("holes", "aspect", "fill", "center", "center_col", "diag_primary", "diag_secondary")])
