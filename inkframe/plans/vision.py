"""Queries over pictures, boxes and regions, each with its SQL or a brute-force test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.geometry import Box
from ..operators import boxes as B
from ..operators import drawing
from ..operators import pixels as P
from ..sources import derived as D
from .registry import query

_PX = D.with_("pixels")
_COLOURS = _PX + """, col AS (SELECT glyph_id, y, x, v AS b, (v*3+x)%256 AS g, (v*5+y)%256 AS r FROM pixels),
gr AS (SELECT *, floor(b*0.114::DOUBLE + g*0.587::DOUBLE + r*0.299::DOUBLE + 0.5)::INT AS v FROM col),
ed AS (SELECT glyph_id, sum(v*e)/sum(e)::DOUBLE AS em, avg((v>=180)::INT) AS br, avg((v<=40)::INT) AS dk FROM (SELECT *, (y=0)::INT+(y=27)::INT+(x=0)::INT+(x=27)::INT AS e FROM gr) GROUP BY glyph_id)"""


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, x, y = F.col("v"), F.col("x"), F.col("y")
    return D.pixels(spark, sf_dir).select("glyph_id", "y", "x", v.alias("b"), ((v * 3 + x) % 256).alias("g"), ((v * 5 + y) % 256).alias("r"))


def _ink(least: int = P.INK) -> Column:
    return F.col("v") >= least


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


# --- grey and ink

@query(_COLOURS + """, m AS (SELECT gr.*, CASE WHEN em <= 35 AND br <= 0.45 THEN v ELSE greatest(255-v, 255-least(b,g,r)) END AS whole, CASE WHEN em <= 35 AND br BETWEEN 0.02 AND 0.45 AND dk >= 0.45 THEN v ELSE greatest(255-v, 255-least(b,g,r)) END AS one FROM gr JOIN ed USING (glyph_id))
SELECT glyph_id, y, sum(whole*(x+1))::BIGINT AS whole, sum(one*(x+1))::BIGINT AS one FROM m GROUP BY ALL""")
def ink_maps(spark, sf_dir):
    """Both ink maps, a checksum for each row of pixels."""
    c = _colours(spark, sf_dir)
    row = lambda d, name: d.groupBy("glyph_id", "y").agg(F.sum(F.col("v") * (F.col("x") + 1)).alias(name)).hint("merge")
    return row(P.ink_map(c), "whole").join(row(P.ink_map(c, whole=False), "one"), ["glyph_id", "y"])


@query(_COLOURS + " SELECT glyph_id, round(em, 6) AS edge_mean, em <= 35 AND br BETWEEN 0.02 AND 0.45 AND dk >= 0.45 AS light_on_dark, em <= 45 AND br >= 0.01 AND dk >= 0.35 AS normalized FROM ed")
def polarity_tests(spark, sf_dir):
    c = _colours(spark, sf_dir)
    p = P.polarity(c.withColumn("v", P.gray(F.col("b"), F.col("g"), F.col("r"))))
    own = [F.col(x) for x in ("edge_mean", "bright", "dark")]
    return p.select("glyph_id", F.round("edge_mean", 6).alias("edge_mean"), P.is_white_on_black(*own, F.col("character")).alias("light_on_dark"), P.is_normalized(*own).alias("normalized"))


@query(_COLOURS + """, s AS (SELECT glyph_id, y, x, CASE WHEN greatest(b,g,r) = 0 THEN 0 ELSE floor((greatest(b,g,r)-least(b,g,r))*255.0::DOUBLE/greatest(b,g,r)+0.5) END::INT AS sat, greatest(b,g,r)-least(b,g,r) AS spread, 255-v AS dn FROM gr),
z AS (SELECT glyph_id, greatest(18, floor(quantile_cont(dn, 0.55)*0.35)) AS zone FROM s GROUP BY glyph_id),
t AS (SELECT glyph_id, floor(least(110, greatest(55, quantile_cont(sat, 0.985)))) AS ts, floor(least(48, greatest(20, quantile_cont(spread, 0.985)))) AS tp, greatest(26, floor(quantile_cont(dn, 0.40))) AS td FROM s JOIN z USING (glyph_id) WHERE dn >= zone GROUP BY glyph_id)
SELECT glyph_id, y, x FROM s JOIN t USING (glyph_id) WHERE dn >= td AND (sat >= ts OR (spread >= tp AND sat >= greatest(32, round_even(ts*0.45, 0))))""")
def coloured_ink(spark, sf_dir):
    return P.coloured(_colours(spark, sf_dir))


@query(_PX + " SELECT glyph_id, x, count(*) FILTER (v >= 128) AS n_ink FROM pixels GROUP BY ALL")
def pixel_columns(spark, sf_dir):
    return P.column_projections(D.pixels(spark, sf_dir))


@query(D.with_("glyphs") + " SELECT image_id, round(quantile_cont(w, 0.55), 6) AS p55, round(quantile_cont(w, 0.985), 6) AS p985, round(quantile_cont(w*h, 0.40), 6) AS p40 FROM glyphs GROUP BY image_id")
def percentiles(spark, sf_dir):
    p = lambda c, q, name: F.round(F.percentile(c, F.lit(q)), 6).alias(name)
    return D.glyphs(spark, sf_dir).groupBy("image_id").agg(p("w", 0.55, "p55"), p("w", 0.985, "p985"), p(F.col("w") * F.col("h"), 0.40, "p40"))


# --- connected parts

def _reach(test: str, near: str, name: str = "pixels") -> str:
    """Parts by spreading the least place from pixel to pixel: nothing like the fold over runs."""
    return f"""ink AS (SELECT glyph_id AS g, y, x FROM {name} WHERE {test}), rooted(g, y, x, root) USING KEY (g, y, x) AS (SELECT g, y, x, y*1000+x FROM ink UNION
 SELECT p.g, p.y, p.x, min(r.root) FROM rooted r JOIN recurring.rooted p ON p.g = r.g AND {near} AND r.root < p.root GROUP BY p.g, p.y, p.x),
part AS (SELECT g AS glyph_id, root, min(x) AS x, min(y) AS y, max(x)-min(x)+1 AS w, max(y)-min(y)+1 AS h, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM rooted GROUP BY g, root)"""


_EIGHT, _FOUR = "abs(p.y-r.y) <= 1 AND abs(p.x-r.x) <= 1", "abs(p.y-r.y) + abs(p.x-r.x) <= 1"
_REC = "WITH RECURSIVE " + D.SQL["pixels"] + ", "
_PARTS = _REC + _reach("v >= 128", _EIGHT)


def _parts(spark, sf_dir):
    return P.parts_of(D.pixels(spark, sf_dir), _ink())


@query(_PARTS + " SELECT glyph_id, x, y, w, h, area, round(cx, 6) AS cx, round(cy, 6) AS cy FROM part")
def ink_parts(spark, sf_dir):
    return _rounded(_parts(spark, sf_dir).drop("part"), "cx", "cy")


@query(_PARTS + ", k AS (SELECT *, row_number() OVER (PARTITION BY glyph_id ORDER BY area DESC, root) AS k, max(area) OVER (PARTITION BY glyph_id) AS top FROM part) SELECT glyph_id, x, y, area FROM k WHERE area >= 40 OR (top < 40 AND k = 1)")
def large_parts(spark, sf_dir):
    return P.without_specks(_parts(spark, sf_dir), 40).select("glyph_id", "x", "y", "area")


@query(_PARTS + """, k AS (SELECT *, row_number() OVER (PARTITION BY glyph_id ORDER BY area DESC, root) AS k FROM part), m AS (SELECT glyph_id, x AS mx, y AS my, w AS mw, h AS mh, area AS ma, greatest(3, round_even(greatest(w, h)*0.55, 0)) AS pad FROM k WHERE k = 1),
j AS (SELECT *, mx-pad AS x0, my-pad AS y0, mx+mw+pad AS x1, my+mh+pad AS y1 FROM k JOIN m USING (glyph_id)),
f AS (SELECT *, NOT (x+w < x0 OR x > x1 OR y+h < y0 OR y > y1) AS ov, abs(cx-(mx+mw/2.0)) <= greatest(7.0, mw*1.15) AND abs(cy-(my+mh/2.0)) <= greatest(7.0, mh*1.15) AS cl, x <= x1+2 AND x+w >= x0-2 AND y <= y1+2 AND y+h >= y0-2 AS tn FROM j)
SELECT glyph_id, x, y, area FROM f WHERE k = 1 OR (area >= greatest(3, round_even(ma*0.035, 0)) AND (ov OR cl OR tn OR area >= greatest(6, round_even(ma*0.20, 0)) OR ((h >= greatest(4, round_even(mh*0.35, 0)) OR w >= greatest(4, round_even(mw*0.35, 0))) AND (ov OR cl))))""")
def character_parts(spark, sf_dir):
    return P.dominant_parts(_parts(spark, sf_dir)).select("glyph_id", "x", "y", "area")


@query(_REC + _reach("v % 4 = 0", _FOUR) + " SELECT glyph_id, x, y, area FROM part WHERE x > 0 AND y > 0 AND x+w-1 < 27 AND y+h-1 < 27")
def ink_holes(spark, sf_dir):
    """Holes of a net: three quarters of all values count as ink."""
    return P.holes(D.pixels(spark, sf_dir), F.col("v") % 4 != 0).select("glyph_id", "x", "y", "area")


@query(_REC + _reach("v % 5 = 0", _EIGHT) + """ SELECT s_suppkey AS glyph_id, count(*) FILTER (area >= 6) AS n_parts FROM supplier LEFT JOIN part ON glyph_id = s_suppkey GROUP BY ALL""")
def part_counts(spark, sf_dir):
    """Parts of six pixels or more among all values that five divides."""
    return P.part_counts(D.pixels(spark, sf_dir), F.col("v") % 5 == 0)


@query(_REC + _reach("v % 16 < 8", _FOUR) + """, near AS (SELECT DISTINCT r.g, r.root, r.y+dy AS y, r.x+dx AS x FROM rooted r, (VALUES (0,1),(0,-1),(1,0),(-1,0)) AS d(dy, dx)),
beside AS (SELECT n.g AS glyph_id, n.root, count(*) AS beside FROM near n ANTI JOIN rooted r ON r.g = n.g AND r.root = n.root AND r.y = n.y AND r.x = n.x GROUP BY ALL),
hole AS (SELECT glyph_id, area + beside/2.0 - 1 AS whole FROM part JOIN beside USING (glyph_id, root) WHERE x > 0 AND y > 0 AND x+w-1 < 27 AND y+h-1 < 27)
SELECT s_suppkey AS glyph_id, count(*) FILTER (whole >= 6) AS n_holes FROM supplier LEFT JOIN hole ON glyph_id = s_suppkey GROUP BY ALL""")
def hole_counts(spark, sf_dir):
    """Holes with an outline of area six or more in a net of ink."""
    return P.hole_counts(D.pixels(spark, sf_dir), F.col("v") % 16 >= 8)


@query(_PX + """, b AS (SELECT glyph_id, count(*) FILTER (i) AS n, count(*) AS size, sum(e) FILTER (i)/sum(e)::DOUBLE AS edge, (max(x) FILTER (i)-min(x) FILTER (i)+1)*(max(y) FILTER (i)-min(y) FILTER (i)+1) AS box FROM (SELECT *, v >= 128 AS i, (y=0)::INT+(y=27)::INT+(x=0)::INT+(x=27)::INT AS e FROM pixels) GROUP BY glyph_id)
SELECT glyph_id, round(-abs(n/size-0.12::DOUBLE) - coalesce(edge, 0)*0.8::DOUBLE + least(n/box, 0.6::DOUBLE)*0.18::DOUBLE, 6) AS score FROM b WHERE n > 0""")
def binary_score(spark, sf_dir):
    return _rounded(P.binary_scores(D.pixels(spark, sf_dir), _ink()), "score")


_SCORED = "WITH RECURSIVE " + D.SQL["pixels"] + ", cand AS (SELECT unnest([1,2,3]) AS c, unnest([100,128,160]) AS least), many AS (SELECT glyph_id*10+c AS glyph_id, y, x, (v >= least)::INT AS i FROM pixels, cand), " + _reach("i = 1", _EIGHT, "many") + """,
w AS (SELECT glyph_id, sum(i) AS n, count(*) AS size, sum(i*e)/sum(e)::DOUBLE AS edge FROM (SELECT *, (y=0)::INT+(y=27)::INT+(x=0)::INT+(x=27)::INT AS e FROM many) GROUP BY glyph_id),
c AS (SELECT glyph_id, count(*) FILTER (area < 6) AS noise, count(*) FILTER (w >= 28*0.20 AND h <= 18) AS lines, count(*) FILTER (h >= 12 AND w <= 24) AS chars FROM part GROUP BY glyph_id),
s AS (SELECT glyph_id // 10 AS glyph_id, glyph_id % 10 AS candidate, CASE WHEN n > 0 THEN -abs(n/size-0.15::DOUBLE) - edge*0.8::DOUBLE - least(noise, 80)*0.01::DOUBLE - lines*0.12::DOUBLE + least(chars, 20)*0.02::DOUBLE END AS score FROM w LEFT JOIN c USING (glyph_id))"""


def _threshold_candidates(spark, sf_dir):
    found = [P.threshold_scores(D.pixels(spark, sf_dir), _ink(least)).withColumn("candidate", F.lit(k)) for k, least in enumerate((100, 128, 160), 1)]
    return _rounded(found[0].unionByName(found[1]).unionByName(found[2]), "score")


@query(_SCORED + " SELECT glyph_id, candidate, round(score, 6) AS score FROM s")
def threshold_score(spark, sf_dir):
    return _threshold_candidates(spark, sf_dir)


@query(_SCORED + ", k AS (SELECT *, row_number() OVER (PARTITION BY glyph_id ORDER BY round(score, 6) DESC NULLS LAST, candidate) AS k FROM s) SELECT glyph_id, candidate FROM k WHERE k = 1")
def threshold_choice(spark, sf_dir):
    return P.best_thresholds(_threshold_candidates(spark, sf_dir))


# --- ruled pages

_RULED = """WITH ruled AS (SELECT n_nationkey AS glyph_id, p // 200 AS y, p % 200 AS x, (p // 200 IN (20, 40) OR ((p % 200) % 37 BETWEEN 5 AND 8 + n_nationkey % 4 AND p // 200 BETWEEN 8 AND 52) OR (p*7 + n_nationkey) % 97 = 0)::INT AS v FROM nation, (SELECT unnest(range(12000)) AS p)),
ink AS (SELECT glyph_id, y, x FROM ruled WHERE v = 1), iso AS (SELECT *, x - row_number() OVER (PARTITION BY glyph_id, y ORDER BY x) AS isle FROM ink), ln AS (SELECT *, count(*) OVER (PARTITION BY glyph_id, y, isle) AS n FROM iso)"""


def _ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(glyph_id, y, x, v): 60 x 200 pages with two ruled lines, thick strokes and specks."""
    p = D.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("glyph_id"), F.explode(F.sequence(F.lit(0), F.lit(11_999))).alias("p"))
    y, x, g = F.floor(F.col("p") / 200), (F.col("p") % 200).cast("long"), F.col("glyph_id")
    stroke = ((x % 37).between(5, 8 + g % 4)) & y.between(8, 52)
    return p.select(g, y.alias("y"), x.alias("x"), (y.isin(20, 40) | stroke | ((F.col("p") * 7 + g) % 97 == 0)).cast("int").alias("v"))


@query(_RULED + " SELECT glyph_id, y, x FROM ln WHERE n >= 50")
def ruled_lines(spark, sf_dir):
    return P.ruled_pixels(_ruled(spark, sf_dir), F.col("v") == 1, 50)


@query(_RULED + """, left_ AS (SELECT glyph_id, y, x FROM ln WHERE n < 50), g9 AS (SELECT unnest([-1,0,1]) AS d), t AS (SELECT ruled.glyph_id, ruled.y, ruled.x, count(l.x) AS votes FROM ruled, g9 a, g9 b LEFT JOIN left_ l ON l.glyph_id = ruled.glyph_id AND l.y = greatest(0, least(59, ruled.y + a.d)) AND l.x = greatest(0, least(199, ruled.x + b.d)) GROUP BY ALL)
SELECT glyph_id, y, x FROM t WHERE votes >= 5""")
def pages_without_lines(spark, sf_dir):
    return P.without_ruled_lines(_ruled(spark, sf_dir), F.col("v") == 1, 200)


@query(_RULED + ", r AS (SELECT glyph_id, y, sum(v) AS n FROM ruled GROUP BY ALL), k AS (SELECT *, max(n) OVER (PARTITION BY glyph_id) AS peak FROM r) SELECT glyph_id, min(y) AS y0, max(y)+1 AS y1 FROM k WHERE n >= greatest(5.0, peak*0.25) GROUP BY glyph_id")
def row_band(spark, sf_dir):
    return P.row_band(_ruled(spark, sf_dir), F.col("v") == 1)


# --- boxes of ink and measures

@query(_PX + """, b AS (SELECT glyph_id, coalesce(min(x) FILTER (v >= 128 + glyph_id % 100), min(x)) AS x0, coalesce(min(y) FILTER (v >= 128 + glyph_id % 100), min(y)) AS y0, coalesce(max(x) FILTER (v >= 128 + glyph_id % 100), max(x))+1 AS x1, coalesce(max(y) FILTER (v >= 128 + glyph_id % 100), max(y))+1 AS y1 FROM pixels GROUP BY glyph_id) SELECT * FROM b""")
def content_boxes(spark, sf_dir):
    return P.content_box(D.pixels(spark, sf_dir), F.col("v") >= 128 + F.col("glyph_id") % 100)


@query(_PX + " SELECT glyph_id, greatest(0, min(x)-3) AS x0, greatest(0, min(y)-3) AS y0, least(28, max(x)+4) AS x1, least(28, max(y)+4) AS y1 FROM pixels WHERE v >= 100 GROUP BY glyph_id")
def export_boxes(spark, sf_dir):
    return P.export_box(D.pixels(spark, sf_dir).withColumn("v", 255 - F.col("v")), 3, 156)


_MEASURED = _REC + _reach("v < 128", _FOUR) + """, hl AS (SELECT glyph_id, count(*)::INT AS holes FROM part WHERE x > 0 AND y > 0 AND x+w-1 < 27 AND y+h-1 < 27 GROUP BY glyph_id),
bx AS (SELECT glyph_id, min(x) AS x0, min(y) AS y0, max(x)-min(x)+1 AS cw, max(y)-min(y)+1 AS ch FROM pixels WHERE v >= 128 GROUP BY glyph_id),
q AS (SELECT glyph_id, x-x0 AS u, y-y0 AS t, cw, ch, greatest(1, cw//2) AS hw, greatest(1, ch//2) AS hh, greatest(1, cw//3) AS tw, greatest(1, ch//3) AS th, (v >= 128)::INT AS i FROM pixels JOIN bx USING (glyph_id) WHERE x >= x0 AND x < x0+cw AND y >= y0 AND y < y0+ch)"""
_SHARE = lambda test: f"coalesce(avg(i) FILTER ({test}), 0)"


@query(_MEASURED + ", f AS (SELECT glyph_id, max(cw) AS content_w, max(ch) AS content_h, round(max(cw)/max(ch)::DOUBLE, 6) AS aspect, round(avg(i), 6) AS fill, " + ", ".join(f"round({_SHARE(t)}, 6) AS \"{n}\"" for n, t in (
    ("left", "u < hw"), ("right", "u >= cw-hw"), ("top", "t < hh"), ("bottom", "t >= ch-hh"), ("center", "t >= th AND t < ch-th AND u >= tw AND u < cw-tw"), ("center_row", "t >= ch//2-1 AND t < ch//2+2"), ("center_col", "u >= cw//2-1 AND u < cw//2+2")))
    + f", round({_SHARE('t < hh AND u < hw')} + {_SHARE('t >= ch-hh AND u >= cw-hw')}, 6) AS diag_primary, round({_SHARE('t < hh AND u >= cw-hw')} + {_SHARE('t >= ch-hh AND u < hw')}, 6) AS diag_secondary FROM q GROUP BY glyph_id) SELECT f.*, coalesce(holes, 0) AS holes FROM f LEFT JOIN hl USING (glyph_id)")
def glyph_features(spark, sf_dir):
    f = P.glyph_features(D.pixels(spark, sf_dir), _ink())
    return _rounded(f, *[c for c in f.columns if c not in ("glyph_id", "content_w", "content_h", "holes")])


@query(_PX + """, s AS (SELECT glyph_id, count(*) FILTER (v >= 128) AS n, count(*) FILTER (v >= 128 AND y >= 8 AND y < 19) AS mid, count(DISTINCT y) FILTER (v >= 128)/28.0 AS density, avg((v >= 128)::INT) FILTER (y < 7) AS top, max(x) FILTER (v >= 128)-min(x) FILTER (v >= 128)+1 AS bw, max(y) FILTER (v >= 128)-min(y) FILTER (v >= 128)+1 AS bh FROM pixels GROUP BY glyph_id)
SELECT glyph_id, round(coalesce(bw/bh, 1.0), 6) AS aspect, round(CASE WHEN n = 0 THEN 0.5 ELSE mid/n END, 6) AS symmetry, round(density, 6) AS density, round(top, 6) AS top, coalesce(n/(bw*bh) < 0.20 AND least(bw, bh) >= 6, false) AS thin FROM s""")
def stroke_measures(spark, sf_dir):
    return _rounded(P.stroke_measures(D.pixels(spark, sf_dir), _ink()), "aspect", "symmetry", "density", "top")


_VALLEYS = _RULED + """, pr AS (SELECT glyph_id, x, sum(v) AS n FROM ruled GROUP BY ALL), sm AS (SELECT a.glyph_id, a.x, sum(b.n)/23.0 AS s FROM pr a JOIN pr b ON a.glyph_id = b.glyph_id AND b.x BETWEEN a.x-11 AND a.x+11 GROUP BY ALL),
nb AS (SELECT *, lag(s) OVER w AS bf, lead(s) OVER w AS af, greatest(coalesce(max(s) OVER (PARTITION BY glyph_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), coalesce(max(s) OVER (PARTITION BY glyph_id ORDER BY x ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 1.0) AS peak FROM sm WINDOW w AS (PARTITION BY glyph_id ORDER BY x)),
vl AS (SELECT glyph_id, x, s/peak AS score FROM nb WHERE s <= bf AND s <= af AND x > 30 AND x < 169 AND s/peak <= 0.95::DOUBLE)"""


def _valleys(spark, sf_dir):
    ruled = _ruled(spark, sf_dir)
    return P.valleys(ruled.groupBy("glyph_id", "x").agg(F.sum("v").alias("n"), F.lit(200).cast("long").alias("width")), most=0.95)


@query(_VALLEYS + " SELECT glyph_id, x, round(score, 6) AS score FROM vl")
def split_valleys(spark, sf_dir):
    return _rounded(_valleys(spark, sf_dir), "score")


@query(_VALLEYS + """, mk AS (SELECT DISTINCT glyph_id, x FROM vl UNION SELECT n_nationkey, 200 FROM nation), sg AS (SELECT glyph_id, coalesce(lag(x) OVER (PARTITION BY glyph_id ORDER BY x), 0) AS x0, x AS x1 FROM mk),
bx AS (SELECT sg.glyph_id, x0 AS segment, min(i.x) AS x, min(i.y) AS y, greatest(2, max(i.x)-min(i.x)+1) AS w, greatest(2, max(i.y)-min(i.y)+1) AS h FROM sg JOIN ink i ON i.glyph_id = sg.glyph_id AND i.x >= x0 AND i.x < x1 WHERE x1-x0 >= 4 GROUP BY ALL)
SELECT * FROM bx QUALIFY count(*) OVER (PARTITION BY glyph_id) >= 2""")
def cut_pieces(spark, sf_dir):
    return P.cut_at(_ruled(spark, sf_dir), F.col("v") == 1, _valleys(spark, sf_dir))


@query()
def split_wide_boxes(spark, sf_dir):
    pages = _ruled(spark, sf_dir)
    return P.split_wide(pages, F.col("v") == 1, pages.groupBy("glyph_id").agg((F.first("glyph_id") % 9 + 1).alias("n")))


# --- fragments

_FRAG = """frag AS (SELECT o_custkey AS image_id, o_orderkey AS glyph_id, (o_orderkey*37)%960//6 AS x, 40+o_orderkey%23 AS y, 4+(o_orderkey*13)%40 AS w, 6+(o_orderkey*17)%90 AS h, ((o_orderkey*13)%60/100.0)::DOUBLE AS fill, o_orderkey%17 = 0 AS is_seven FROM orders),
md AS (SELECT *, median(w) OVER p AS mw, median(h) OVER p AS mh, median(w*h) OVER p AS ma, median(y+h/2.0) OVER p AS mcy FROM frag WINDOW p AS (PARTITION BY image_id))"""


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, glyph_id, x, y, w, h, fill, is_seven): boxes close to one another."""
    k = F.col("o_orderkey")
    return D.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("image_id"), k.alias("glyph_id"), F.floor(k * 37 % 960 / 6).alias("x"), (40 + k % 23).alias("y"), (4 + k * 13 % 40).alias("w"), (6 + k * 17 % 90).alias("h"), (k * 13 % 60 / 100.0).cast("double").alias("fill"), (k % 17 == 0).alias("is_seven"))


def _pair_ink(a: Box, b: Box) -> dict[str, Column]:
    """Ink measures of a pair, by formula."""
    share = lambda n, d: (n % d / 100.0).cast("double")
    return {"fill": share(a.x * 13 + b.x * 7 + a.w + b.h, 50), "holes": (a.x + b.w) % 3, "parts": (a.y + b.x) % 5 + 1, "small_fill": share(a.x + b.y, 60), "small_center": share(a.w + b.x, 80),
            "small_diag": 0.4 + share(a.x + b.w, 60), "small_diag2": 0.4 + share(b.x + a.w, 60)}


_PAIRS = "WITH " + _FRAG + """, nx AS (SELECT *, lead(glyph_id) OVER o AS b_id, lead(x) OVER o AS bx, lead(y) OVER o AS y_b, lead(w) OVER o AS bw, lead(h) OVER o AS bh FROM md WINDOW o AS (PARTITION BY image_id ORDER BY x, glyph_id)),
pm AS (SELECT image_id, glyph_id, b_id, x AS x1, y AS y1, w AS w1, h AS h1, bx AS x2, y_b AS y2, bw AS w2, bh AS h2, mw, mh, (x*13+bx*7+w+bh)%50/100.0::DOUBLE AS fill, (x+bw)%3 AS holes, (y+bx)%5+1 AS parts, (x+y_b)%60/100.0::DOUBLE AS sf, (w+bx)%80/100.0::DOUBLE AS sc, 0.4::DOUBLE+(x+bw)%60/100.0::DOUBLE AS sd, 0.4::DOUBLE+(bx+w)%60/100.0::DOUBLE AS sd2,
 w*h <= bw*bh AS first_small FROM nx WHERE b_id IS NOT NULL),
sz AS (SELECT *, CASE WHEN first_small THEN x1 ELSE x2 END AS sx, CASE WHEN first_small THEN y1 ELSE y2 END AS sy, CASE WHEN first_small THEN w1 ELSE w2 END AS sw, CASE WHEN first_small THEN h1 ELSE h2 END AS sh, CASE WHEN first_small THEN x2 ELSE x1 END AS lx, CASE WHEN first_small THEN y2 ELSE y1 END AS ly, CASE WHEN first_small THEN w2 ELSE w1 END AS lw, CASE WHEN first_small THEN h2 ELSE h1 END AS lh,
 greatest(0, x2-(x1+w1)) AS gap, greatest(0, least(x1+w1, x2+w2)-greatest(x1, x2)) AS xo, greatest(0, least(y1+h1, y2+h2)-greatest(y1, y2)) AS yo, greatest(0, greatest(y1, y2)-least(y1+h1, y2+h2)) AS vg, greatest(x1+w1, x2+w2)-x1 AS cw, greatest(y1+h1, y2+h2)-least(y1, y2) AS ch, abs(y1+h1/2.0-y2-h2/2.0) AS cdy FROM pm),
rl AS (SELECT image_id, glyph_id, b_id,
 gap <= greatest(3, mw*0.08, mh*0.05) AND yo >= least(h1, h2)*0.55 AND least(h1, h2)/greatest(h1, h2) >= 0.72 AND cw/ch BETWEEN 0.52 AND 1.18 AND CASE WHEN holes = 1 AND greatest(w1, w2) <= greatest(120, mw*1.2) AND cw <= greatest(180, mw*1.75) AND ch <= greatest(190, mh*1.35) THEN fill BETWEEN 0.14 AND 0.48
  ELSE greatest(w1, w2) <= greatest(42, mh*0.4) AND cw <= greatest(68, mh*0.78) AND holes >= 1 AND fill BETWEEN 0.10 AND 0.42 END AS digit,
 CASE WHEN y2 < y1 THEN h2 <= greatest(18, mh*0.22) AND w2 >= greatest(22, mw*0.7) AND w1 <= greatest(14, mw*0.25) AND h1 <= greatest(42, mh*0.4) AND greatest(0, x1-(x2+w2)) <= greatest(18, mw*0.32) AND greatest(0, y1-(y2+h2)) >= greatest(20, mh*0.4)
  ELSE h1 <= greatest(18, mh*0.22) AND w1 >= greatest(22, mw*0.7) AND w2 <= greatest(14, mw*0.25) AND h2 <= greatest(42, mh*0.4) AND gap <= greatest(18, mw*0.32) AND greatest(0, y2-(y1+h1)) >= greatest(20, mh*0.4) END AND cw <= greatest(72, mw*1.25) AND ch <= greatest(190, mh*1.8) AS top_bar,
 sw*sh <= greatest(900, lw*lh*0.35) AND sw <= greatest(42, mw*0.68) AND sh <= greatest(52, mh*0.46) AND greatest(0, greatest(x1, x2)-least(x1+w1, x2+w2)) <= greatest(18, mw*0.32) AND yo >= sh*0.45 AND abs(sy+sh/2.0-ly-lh/2.0) <= greatest(28, lh*0.38) AND (sx+sw <= lx+greatest(8, lw*0.38) OR sx >= lx+lw-greatest(8, lw*0.38)) AND cw <= greatest(150, mw*2.35) AND ch <= greatest(lh*1.15, mh*1.15) AS satellite,
 gap <= greatest(26, mw*0.42) AND h1 <= h2*0.72 AND w1 >= greatest(28, w2*0.75) AND w1 <= greatest(52, mw*0.82) AND w2 <= greatest(44, mw*0.7) AND h2 >= greatest(92, mh*0.9) AND yo >= h1*0.82 AND y1 >= y2+greatest(6, h2*0.05) AND x2+w2-x1 <= greatest(112, mw*1.78) AND ch <= greatest(150, mh*1.25) AS short_left,
 gap <= greatest(10, mw*0.2) AND yo >= least(h1, h2)*0.18 AND cdy >= greatest(18, mh*0.28) AND cw <= greatest(92, mw*2.1) AND ch <= greatest(180, mh*2) AND greatest(w1, w2) <= greatest(72, mw*1.15) AND least(h1, h2) >= greatest(26, mh*0.45) AND fill BETWEEN 0.07 AND 0.46 AND parts <= 3 AS staggered,
 sw*sh <= greatest(850, lw*lh*0.28) AND sw <= greatest(32, mw*0.55) AND sh <= greatest(62, mh*0.65) AND gap <= greatest(42, mw*0.95) AND cdy <= greatest(28, mh*0.38) AND cw <= greatest(124, mw*2.1) AND ch <= greatest(170, mh*1.35) AND (sx+sw <= lx+greatest(12, lw*0.28) OR sx >= lx+lw-greatest(12, lw*0.28))
  AND NOT (sw >= greatest(10, mw*0.18) AND sw <= greatest(30, mw*0.7) AND sh <= greatest(6, mh*0.16) AND sw/sh >= 2.6 AND sf >= 0.18)
  AND NOT (sw >= greatest(18, mw*0.55) AND sw <= greatest(44, mw*1.2) AND sh >= greatest(18, mh*0.24) AND sh <= greatest(46, mh*0.72) AND sw/sh BETWEEN 0.6 AND 1.4 AND sf BETWEEN 0.18 AND 0.55 AND sc >= 0.35 AND sd >= 0.52 AND sd2 >= 0.52 AND abs(sd-sd2) <= 0.25) AND fill BETWEEN 0.04 AND 0.48 AND parts <= 4 AS "offset",
 cw <= greatest(118, mw*1.58) AND ch <= greatest(190, mh*1.45) AND (gap <= greatest(8, mw*0.12) OR xo >= greatest(3, least(w1, w2)*0.15)) AND vg <= greatest(18, mh*0.18) AND cdy <= greatest(34, mh*0.36) AND (sw*sh <= greatest(1100, lw*lh*0.42) OR sw <= greatest(28, mw*0.4) OR sh <= greatest(34, mh*0.34)) AND NOT (h1 >= mh*0.8 AND h2 >= mh*0.8 AND gap >= greatest(2, mw*0.05))
  AND NOT (sh >= greatest(72, mh*0.82) AND sw >= greatest(18, mw*0.26) AND sw*sh >= greatest(1500, mh*mw*0.22) AND xo <= greatest(2, sw*0.1) AND gap >= greatest(4, mw*0.06)) AND (sx+sw <= lx+greatest(10, lw*0.34) OR sx >= lx+lw-greatest(10, lw*0.34) OR (sx >= lx AND sx+sw <= lx+lw) OR sy+sh <= ly+greatest(12, lh*0.34) OR sy >= ly+lh-greatest(12, lh*0.34) OR (sy >= ly AND sy+sh <= ly+lh))
  AND fill BETWEEN 0.05 AND 0.55 AND holes <= 2 AND parts <= 3 AND (yo >= least(h1, h2)*0.12 OR vg <= greatest(8, mh*0.08)) AS inline,
 cw <= greatest(32, mw*1.62) AND ch <= greatest(194, mh*1.55) AND sw*sh <= greatest(1000, lw*lh*0.34) AND sw <= greatest(24, mw*0.34) AND sh <= greatest(48, mh*0.52) AND (xo >= greatest(4, sw*0.22) OR gap <= greatest(8, mw*0.1)) AND yo <= sh*0.55 AND vg <= greatest(32, mh*0.28) AND (sy+sh <= ly+greatest(18, lh*0.34) OR sy >= ly+lh-greatest(18, lh*0.34)) AND fill BETWEEN 0.05 AND 0.50 AND parts <= 4 AS corner FROM sz)"""


@query(_PAIRS + " SELECT * FROM rl")
def fragment_pairs(spark, sf_dir):
    """Neighbours and the rules by which they are one character."""
    n = B.neighbours(_fragments(spark, sf_dir), _pair_ink).filter("b_glyph_id is not null")
    return n.select("image_id", "glyph_id", F.col("b_glyph_id").alias("b_id"), *B.PAIR_RULES)


@query(_PAIRS + """, f AS (SELECT image_id, glyph_id, b_id, digit OR top_bar OR satellite OR short_left OR staggered OR "offset" OR inline OR corner AS fits FROM rl), n AS (SELECT frag.*, coalesce(fits, false) AS fits, b_id, row_number() OVER (PARTITION BY image_id ORDER BY x, glyph_id) AS k FROM frag LEFT JOIN f USING (image_id, glyph_id)),
t AS (SELECT *, k - coalesce(max(CASE WHEN NOT fits THEN k END) OVER (PARTITION BY image_id ORDER BY k ROWS UNBOUNDED PRECEDING), 0) AS run FROM n), u AS (SELECT *, fits AND run % 2 = 1 AS taken FROM t), g AS (SELECT *, k - coalesce(lag(taken) OVER (PARTITION BY image_id ORDER BY k), false)::INT AS grp FROM u)
SELECT image_id, min(glyph_id) AS glyph_id, min(x) AS x, min(y) AS y, max(x+w)-min(x) AS w, max(y+h)-min(y) AS h FROM g GROUP BY image_id, grp""")
def merge_pairs_once(spark, sf_dir):
    return B.merge_digit_pairs(_fragments(spark, sf_dir), _pair_ink, passes=1)


@query()
def merge_pairs(spark, sf_dir):
    return B.merge_digit_pairs(_fragments(spark, sf_dir), _pair_ink)


@query()
def merge_fixpoint(spark, sf_dir):
    return B.merge_broken(D.glyphs(spark, sf_dir))


@query("WITH " + _FRAG + f""", m AS (SELECT *, w/h AS ra, ((x+y)%30/100.0)::DOUBLE AS tp, ((x*3+y)%30/100.0)::DOUBLE AS bt, (x+w)%5 AS pt, ((w+x)%80/100.0)::DOUBLE AS ce, 0.4::DOUBLE+((x+w)%60/100.0)::DOUBLE AS d1, 0.4::DOUBLE+((y+w)%60/100.0)::DOUBLE AS d2 FROM md)
SELECT glyph_id, w >= greatest(10, mw*0.18) AND w <= greatest(30, mw*0.7) AND h <= greatest(6, mh*0.16) AND ra >= 2.6 AND fill >= 0.18 AS dash,
 w >= greatest(18, mw*0.55) AND w <= greatest(44, mw*1.2) AND h >= greatest(18, mh*0.24) AND h <= greatest(46, mh*0.72) AND ra BETWEEN 0.6 AND 1.4 AND fill BETWEEN 0.18 AND 0.55 AND ce >= 0.35 AND d1 >= 0.52 AND d2 >= 0.52 AND abs(d1-d2) <= 0.25 AS x_like,
 w >= greatest(14, mw*0.6) AND w <= greatest(76, mw*1.25) AND h >= greatest(80, mh*1.15) AND ra BETWEEN 0.22 AND 0.58 AND fill BETWEEN 0.04 AND 0.11 AND tp >= 0.12 AND bt <= 0.08 AND pt BETWEEN 2 AND 3 AS seven,
 CASE WHEN least(w/mw, CASE WHEN w/mh < 0.6 THEN w/mh*1.5 ELSE 1e9 END) < 1.55 THEN 1 WHEN least(w/mw, CASE WHEN w/mh < 0.6 THEN w/mh*1.5 ELSE 1e9 END) < 2.45 THEN 2 WHEN least(w/mw, CASE WHEN w/mh < 0.6 THEN w/mh*1.5 ELSE 1e9 END) < 3.45 THEN 3 ELSE round_even(least(w/mw, CASE WHEN w/mh < 0.6 THEN w/mh*1.5 ELSE 1e9 END), 0)::INT END AS n_chars,
 greatest(0, x-greatest(4, round_even(greatest(w, h)*0.15, 0)::INT)) AS x0, least(200, x+w+greatest(4, round_even(greatest(w, h)*0.15, 0)::INT)) AS x1, x || ',' || y || ',' || w || ',' || h AS rect FROM m""")
def fragment_tests(spark, sf_dir):
    """Dashes, crosses, sparse sevens, character counts and crops of boxes."""
    b, image = Box(), Window.partitionBy("image_id")
    share = lambda n, d: (n % d / 100.0).cast("double")
    own = {"top": share(b.x + b.y, 30), "bottom": share(b.x * 3 + b.y, 30), "parts": (b.x + b.w) % 5, "center": share(b.w + b.x, 80), "d1": 0.4 + share(b.x + b.w, 60), "d2": 0.4 + share(b.y + b.w, 60)}
    f = _fragments(spark, sf_dir).withColumns({"mw": F.median("w").over(image), "mh": F.median("h").over(image)} | own)
    m = {c: F.col(c) for c in ("w", "h", "mw", "mh", "fill", "top", "bottom", "parts", "center")} | {"ratio": b.w / b.h, "diag_primary": F.col("d1"), "diag_secondary": F.col("d2"), "diag_apart": F.abs(F.col("d1") - F.col("d2"))}
    crop = G.padded(b, 200, 200)
    return f.select("glyph_id", G.bound(m, G.DASH).alias("dash"), G.bound(m, G.X_LIKE).alias("x_like"), G.bound(m, G.SPARSE_SEVEN).alias("seven"), G.capped_count(b.w, F.col("mw"), F.col("mh")).alias("n_chars"), crop[0], crop[2], F.array_join(G.as_list(b).cast("array<string>"), ",").alias("rect"))


_DROPS = """(w*h < 6 AND w*h < ma*0.08) OR (fill < 0.06 AND w*h > 12 AND NOT is_seven) OR (w/h >= 6 AND w >= greatest(36, mw*1.4) AND h <= greatest(18, mh*0.65) AND fill <= 0.55)
 OR ((x <= 6 OR y <= 6 OR x+w >= 194 OR y+h >= 114) AND ((w*h < greatest(6, ma*0.12) AND w < mw*0.75 AND h < mh*0.75) OR (fill <= 0.35 AND ((w/h >= 4.5 AND w >= mw*1.2) OR (h/w >= 4.5 AND h >= mh*1.2)))))"""


@query("WITH " + _FRAG + f" SELECT image_id, glyph_id FROM md WHERE NOT ({_DROPS})")
def ink_filter(spark, sf_dir):
    return B.ink_filter(_fragments(spark, sf_dir), 200, 120).select("image_id", "glyph_id")


@query("WITH " + _FRAG + f""" SELECT image_id, min(glyph_id) AS glyph_id, x, y, w, h FROM md WHERE NOT ({_DROPS}) OR (abs(y+h/2.0-mcy) <= greatest(12, mh*0.9) AND ((w >= greatest(6, mw*0.35) AND w <= greatest(28, mw*1.8) AND h <= greatest(12, mh*0.45) AND fill >= 0.18)
 OR (w*h >= 4 AND w <= greatest(10, mw*0.5) AND h <= greatest(10, mh*0.5) AND fill >= 0.12) OR (w <= greatest(14, mw*0.7) AND h >= greatest(10, mh*0.45) AND h <= greatest(28, mh*1.4) AND fill >= 0.12))) GROUP BY image_id, x, y, w, h""")
def operator_filter(spark, sf_dir):
    return B.operator_filter(_fragments(spark, sf_dir), 200, 120)


@query("WITH " + _FRAG + """, s AS (SELECT * FROM frag WHERE w*h >= 20 AND fill >= 0.05 AND NOT (w >= 90 AND h <= 19) AND w <= 120 AND NOT (h < 18 AND fill < 0.20) AND NOT (h < 26 AND fill < 0.15) AND h <= 110),
m AS (SELECT *, median(w) OVER p AS mw, median(h) OVER p AS mh, median(w*h) OVER p AS ma, x <= 6 OR x+w >= 194 AS lr, y <= 9.6 OR y+h >= 110.4 AS tb FROM s WINDOW p AS (PARTITION BY image_id))
SELECT image_id, glyph_id FROM m WHERE NOT (tb AND h >= mh*1.3 AND w*h >= ma*1.3) AND NOT (lr AND w >= mw*1.45 AND h >= mh*1.15) AND NOT ((tb OR lr) AND (w >= mw*1.85 OR h >= mh*1.8))""")
def band_filter(spark, sf_dir):
    return B.band_filter(_fragments(spark, sf_dir), 200, 120).select("image_id", "glyph_id")


@query("WITH " + _FRAG + """, c AS (SELECT image_id, y+h/2.0 AS cy, greatest(18, floor(median(h) OVER (PARTITION BY image_id)*0.65)) AS snap FROM frag), st AS (SELECT image_id, cy-lag(cy) OVER (PARTITION BY image_id ORDER BY cy) AS d, snap FROM c), rw AS (SELECT image_id, count(*) FILTER (d > snap)+1 AS n_rows FROM st GROUP BY image_id),
g AS (SELECT image_id, count(*) AS n, image_id % 40 AS score, median(h) AS mh, stddev_pop(h) AS sh, count(*) FILTER (w >= 36 AND h <= 18) AS lines FROM frag GROUP BY image_id)
SELECT image_id, CASE WHEN n < 2 THEN 'Too few rects (' || n || ' < 2)' WHEN score < 10 THEN 'Score too low (' || score || '.0 < 10.0)' WHEN sh > mh*0.65 THEN 'Heights inconsistent (std/med=' || printf('%.2f', sh/mh) || ' > 0.4)' WHEN lines >= n*0.5 THEN 'Line-dominated (' || lines || '/' || n || ')' WHEN n_rows > 1 THEN 'Multiple rows detected (' || n_rows || ' > 1)' ELSE 'Valid band result' END AS reason FROM g JOIN rw USING (image_id)""")
def band_validation(spark, sf_dir):
    return B.band_validation(_fragments(spark, sf_dir).withColumn("score", (F.col("image_id") % 40).cast("double")), 200, 120)


@query("WITH " + _FRAG + ", g AS (SELECT image_id, count(*) AS n, count(*) FILTER (w >= 36 AND h <= 18) AS lines, median(w) AS mw, median(h) AS mh, median(w/h) AS mr FROM frag GROUP BY image_id) SELECT image_id, lines >= greatest(3, round_even(n*0.4, 0)) OR (n >= 5 AND mw >= 50 AND mh <= 18 AND mr >= 5.5) AS dominated FROM g")
def line_dominated(spark, sf_dir):
    return B.line_dominated(_fragments(spark, sf_dir), 200, 120)


_SPLIT = "WITH " + _FRAG + ", ex AS (SELECT * FROM frag WHERE glyph_id % 3 > 0), cm AS (SELECT *, w*h AS area FROM frag WHERE glyph_id % 3 = 0)"
_OVER = "greatest(0, least(a.x+a.w, b.x+b.w)-greatest(a.x, b.x)) * greatest(0, least(a.y+a.h, b.y+b.h)-greatest(a.y, b.y)) >= 0.72*least(a.w*a.h, b.w*b.h)"


@query(_SPLIT + f""", e AS (SELECT image_id, median(w) AS mw, median(h) AS mh, median(y+h/2.0) AS mc FROM ex GROUP BY image_id), c AS (SELECT image_id, median(w) AS mw, median(h) AS mh, median(y+h/2.0) AS mc FROM cm WHERE area >= 8 GROUP BY image_id),
t AS (SELECT c.image_id, coalesce(e.mw, c.mw) AS mw, coalesce(e.mh, c.mh) AS mh, coalesce(e.mc, c.mc) AS mc FROM c LEFT JOIN e USING (image_id))
SELECT a.image_id, a.glyph_id FROM cm a JOIN t USING (image_id) WHERE area >= 8 AND NOT EXISTS (SELECT 1 FROM ex b WHERE b.image_id = a.image_id AND {_OVER}) AND abs(y+h/2.0-mc) <= greatest(18, mh*1.05)
 AND ((w >= greatest(10, mw*0.22) AND w <= greatest(42, mw*1.05) AND h <= greatest(6, mh*0.18) AND w/h >= 2.2 AND fill >= 0.18) OR (x > 3 AND x+w < 197 AND h >= greatest(24, mh*1.2, 40*0.68) AND w >= greatest(8, mw*0.18) AND w <= greatest(28, mw*0.85) AND w/h <= 0.42 AND fill BETWEEN 0.08 AND 0.40))""")
def recovered_operators(spark, sf_dir):
    f = _fragments(spark, sf_dir)
    found = f.filter("glyph_id % 3 = 0").withColumn("area", F.col("w") * F.col("h"))
    return B.recovered_operators(found, f.filter("glyph_id % 3 > 0"), 200, 40).select("image_id", "glyph_id")


@query()
def boxes_added(spark, sf_dir):
    f = _fragments(spark, sf_dir)
    return B.added_clear(f.filter("glyph_id % 3 > 0"), f.filter("glyph_id % 3 = 0"))


# --- regions

_REGIONS = "WITH " + _FRAG + ", rg AS (SELECT image_id, glyph_id AS ord, (x-12)*5 AS x0, (y-50)*9 AS y0, (x-12)*5+w*2-20 AS x1, (y-50)*9+h*2-30 AS y1 FROM frag)"


def _regions(spark, sf_dir):
    x, y = (F.col("x") - 12) * 5, (F.col("y") - 50) * 9
    return _fragments(spark, sf_dir).select("image_id", F.col("glyph_id").alias("ord"), x.alias("x0"), y.alias("y0"), (x + F.col("w") * 2 - 20).alias("x1"), (y + F.col("h") * 2 - 30).alias("y1"))


_DISTINCT = _REGIONS + ", cl AS (SELECT image_id, ord, greatest(0, x0)::INT AS x0, greatest(0, y0)::INT AS y0, greatest(greatest(0, x0)+1, x1)::INT AS x1, greatest(greatest(0, y0)+1, y1)::INT AS y1 FROM rg), ds AS (SELECT image_id, x0, y0, x1, y1, min(ord) AS ord FROM cl WHERE (x1-x0)*(y1-y0) >= 64 GROUP BY ALL)"


@query(_DISTINCT + " SELECT * FROM ds")
def distinct_regions(spark, sf_dir):
    return B.distinct_regions(_regions(spark, sf_dir))


@query(_DISTINCT + """, ls AS (SELECT image_id, list([x0, y0, x1, y1] ORDER BY x0, y0, x1, y1) AS r FROM ds GROUP BY image_id),
fold AS (SELECT image_id, list_reduce(list_transform(r, lambda e: [e]), lambda acc, e: CASE WHEN least(e[1][3], acc[-1][3])-greatest(e[1][1], acc[-1][1]) > -16 AND least(e[1][4], acc[-1][4])-greatest(e[1][2], acc[-1][2]) > -10 AND e[1][1] <= acc[-1][3]+16 AND e[1][3] >= acc[-1][1]-16 AND e[1][2] <= acc[-1][4]+10 AND e[1][4] >= acc[-1][2]-10
 THEN list_append(acc[:-2], [least(acc[-1][1], e[1][1]), least(acc[-1][2], e[1][2]), greatest(acc[-1][3], e[1][3]), greatest(acc[-1][4], e[1][4])]) ELSE list_concat(acc, e) END) AS m FROM ls), un AS (SELECT image_id, unnest(m) AS r FROM fold) SELECT image_id, r[1] AS x0, r[2] AS y0, r[3] AS x1, r[4] AS y1 FROM un""")
def merged_regions(spark, sf_dir):
    return B.merged_regions(B.distinct_regions(_regions(spark, sf_dir)), 800, 300)


_ROWED = "WITH " + _FRAG + """, ch AS (SELECT *, y+h/2.0 AS cy FROM md WHERE w*h >= 8 AND h >= 8 AND h <= 96 AND w <= 150 AND NOT (w/h > 12 AND h < mh*0.7)), nw AS (SELECT *, CASE WHEN cy-lag(cy) OVER (PARTITION BY image_id ORDER BY cy, glyph_id) > greatest(16, floor(mh*0.85)) THEN 1 ELSE 0 END AS nw FROM ch),
li AS (SELECT *, sum(nw) OVER (PARTITION BY image_id ORDER BY cy, glyph_id ROWS UNBOUNDED PRECEDING)::BIGINT AS ord FROM nw),
rr AS (SELECT image_id, ord, greatest(0, min(x)-greatest(12, floor(first(mw)*0.9)))::INT AS x0, greatest(0, min(y)-greatest(12, floor(first(mh)*0.9)))::INT AS y0, least(200, max(x+w)+greatest(12, floor(first(mw)*0.9)))::INT AS x1, least(120, max(y+h)+greatest(12, floor(first(mh)*0.9)))::INT AS y1 FROM li GROUP BY image_id, ord),
rq AS (SELECT * FROM rr WHERE x1-x0 >= 28 AND y1-y0 >= 24)"""
_REGION_SCORES = _ROWED + """, ow AS (SELECT rq.*, f.x, f.y, f.w, f.h, median(f.w) OVER p AS mw, median(f.h) OVER p AS mh FROM rq JOIN frag f ON f.image_id = rq.image_id AND f.x >= x0 AND f.y >= y0 AND f.x+f.w <= x1 AND f.y+f.h <= y1 WINDOW p AS (PARTITION BY rq.image_id, ord)),
gs AS (SELECT image_id, ord, count(*) AS n, first(mw) AS mw, first(mh) AS mh, first(x1-x0) AS rw, first(y1-y0) AS rh, count(*) FILTER (w >= (x1-x0)*0.28 AND h <= greatest(10, mh*0.45)) AS lines, max(x+w)-min(x) AS sx, max(y+h)-min(y) AS sy, stddev_pop(y+h/2.0) AS ji, (first(x0+y1)%40/100.0)::DOUBLE AS fg FROM ow GROUP BY image_id, ord),
sc AS (SELECT image_id, ord, n, least(8.0, n*1.5)+least(4.0, sx/rw*5.0)+least(4.0, rw/rh*0.6::DOUBLE)+least(4.0, sx*sy/(rw*rh)::DOUBLE*5.0)-least(6.0, lines*1.5)-abs(fg-0.18::DOUBLE)*8-least(4.0, ji/greatest(1, mh)*2.5)-abs(mw-mh)/greatest(1, mh)*0.8::DOUBLE-greatest(0.0, rw*rh/24000.0::DOUBLE-0.45::DOUBLE)*10 AS score FROM gs)"""


@query(_ROWED + " SELECT * FROM rq")
def row_regions(spark, sf_dir):
    return B.row_regions(_fragments(spark, sf_dir), 200, 120)


def _region_scores(spark, sf_dir):
    f = _fragments(spark, sf_dir)
    regions = B.row_regions(f, 200, 120).withColumn("fg_ratio", ((F.col("x0") + F.col("y1")) % 40 / 100.0).cast("double"))
    return _rounded(B.region_scores(regions, f, 200, 120), "score")


@query(_REGION_SCORES + " SELECT image_id, ord, n, round(score, 6) AS score FROM sc")
def region_scores(spark, sf_dir):
    return _region_scores(spark, sf_dir)


@query(_REGION_SCORES + " SELECT image_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(score, 6) DESC, ord) AS k FROM sc) WHERE k = 1")
def best_region(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("score"), "ord"))
    return _region_scores(spark, sf_dir).withColumn("k", k).filter("k = 1").select("image_id", "ord")


_CHOICES = "WITH ca AS (SELECT o_custkey AS image_id, (['band','full','region'])[o_orderkey%3+1] AS name, o_orderkey%12 AS n, ((o_orderkey*7)%40/4.0)::DOUBLE AS score, ((o_orderkey*11)%100/100.0)::DOUBLE AS span FROM orders), u AS (SELECT image_id, name, max(n) AS n, max(score) AS score, max(span) AS span FROM ca GROUP BY image_id, name)"


@query(_CHOICES + """, k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, n DESC, span DESC, name) AS k FROM u), r AS (SELECT * FROM u WHERE name = 'region')
SELECT k.image_id, CASE WHEN k.name <> 'region' AND r.n-k.n >= 3 AND k.score-r.score <= 1.5 AND r.span >= k.span-0.03 THEN 'region' ELSE k.name END AS name FROM k LEFT JOIN r ON r.image_id = k.image_id WHERE k = 1""")
def preferred_candidate(spark, sf_dir):
    k = F.col("o_orderkey")
    c = D.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_id"), F.element_at(F.array(*[F.lit(x) for x in ("band", "full", "region")]), (k % 3 + 1).cast("int")).alias("name"), (k % 12).alias("n"), (k * 7 % 40 / 4.0).alias("score"), (k * 11 % 100 / 100.0).alias("span"))
    return B.preferred(c.groupBy("image_id", "name").agg(F.max("n").alias("n"), F.max("score").alias("score"), F.max("span").alias("span_ratio")))


@query("WITH RECURSIVE " + _FRAG + """, gp AS (SELECT image_id, greatest(26, floor(median(w)*0.6)) AS gap FROM frag GROUP BY image_id), sd AS (SELECT image_id, min(x) AS x0, min(x+w) AS x1 FROM frag WHERE glyph_id % 5 = 0 GROUP BY image_id),
gr AS (SELECT sd.image_id, x0, x1, 0 AS k FROM sd UNION ALL SELECT g.image_id, least(g.x0, min(f.x)), greatest(g.x1, max(f.x+f.w)), k+1 FROM gr g JOIN gp ON gp.image_id = g.image_id JOIN frag f ON f.image_id = g.image_id AND f.x-g.x1 <= gap AND g.x0-(f.x+f.w) <= gap WHERE k < 40 GROUP BY g.image_id, g.x0, g.x1, k)
SELECT image_id, min(x0) AS x0, max(x1) AS x1 FROM gr GROUP BY image_id""".replace("median(w)*0.6", "median(w)*3.2"))
def row_reach(spark, sf_dir):
    f = _fragments(spark, sf_dir)
    seeds = f.filter("glyph_id % 5 = 0").groupBy("image_id").agg(F.min("x").alias("x0"), F.min(Box().right).alias("x1"))
    return B.row_reach(f, seeds)


# --- training pictures

def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # six pictures a number, a digest for each of their pixels
    return D.dealt(D.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("number")), "number", 20_000)


_U = lambda name: f"(('0x' || substr(md5('42:' || symbol || ':' || number || ':{name}'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE)"


@query(f"""WITH s AS (SELECT unnest(['+','-','*','/','(',')']) AS symbol, unnest([2,2,2,1,1,1]) AS dx, unnest([2,1,2,1,2,2]) AS dy, unnest([10,10,10,13,14,14]) AS s0, unnest([17,17,16,18,18,18]) AS s1, unnest([3,2,2,2,2,2]) AS t1, unnest([10.0,4.0,8.0,5.0,6.0,6.0])::DOUBLE AS turn, unnest([7.0,5.0,6.0,4.0,4.0,4.0])::DOUBLE AS noise),
e AS (SELECT s.*, s_suppkey AS number FROM s, supplier)
SELECT symbol, number, (14-dx+floor({_U('cx')}*(2*dx+1)))::INT AS cx, (14-dy+floor({_U('cy')}*(2*dy+1)))::INT AS cy, (s0+floor({_U('size')}*(s1-s0+1)))::INT AS size, (1+floor({_U('thickness')}*t1))::INT AS thickness, round(({_U('angle')}*2-1)*turn, 6) AS angle, noise, (-10+floor({_U('shift')}*21))::INT AS shift FROM e""")
def drawing_parameters(spark, sf_dir):
    """A picture of each symbol for each supplier's key."""
    return _rounded(drawing.parameters(_numbers(spark, sf_dir)), "angle")


@query()
def drawn_symbols(spark, sf_dir):
    """The pictures of ``drawing_parameters``, measured: share of ink, mean of ink and of ground."""
    d = drawing.drawn(drawing.parameters(_numbers(spark, sf_dir)))
    ink = F.col("v") >= 128
    return d.groupBy("symbol", "number").agg(F.avg(ink.cast("double")).alias("share"), F.avg(F.when(ink, F.col("v"))).alias("light"), F.avg(F.when(~ink, F.col("v"))).alias("dark"))
