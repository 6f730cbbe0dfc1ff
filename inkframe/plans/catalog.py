"""All queries of the library by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import boxes as B
from ..operators import context as C
from ..operators import expressions as X
from ..operators import feedback as K
from ..operators import lines as L
from ..operators import metrics as M
from ..operators import pixels as P
from ..sources import derived as D
from ..streaming.feedback import counted_stream
from .registry import ORACLE, QUERIES, query

WIDTH, HEIGHT = 1000, 300


# --- expressions

_CLEANED = D.with_("exprs") + r""",
t AS (SELECT *, regexp_replace(regexp_replace(raw, '\++', '+', 'g'), '\*+', '*', 'g') AS cleaned FROM exprs),
n AS (SELECT *, regexp_replace(regexp_replace(cleaned, '([0-9)])\(', '\1*(', 'g'), '\)([0-9])', ')*\1', 'g') AS expression FROM t)"""
_STATUS = """CASE WHEN regexp_full_match(expression, '[0-9]+') THEN 'ok' WHEN regexp_matches(expression, '^[+*/)]') THEN 'Validation failed: Expression cannot start with ''' || left(expression, 1) || '''.'
 WHEN regexp_matches(expression, '[-+*/(]$') THEN 'Validation failed: Expression cannot end with ''' || right(expression, 1) || '''.'
 WHEN regexp_matches(expression, '[-+*/][-+*/]') THEN 'Validation failed: Two consecutive operators ''' || left(regexp_extract(expression, '[-+*/][-+*/]'), 1) || ''' and ''' || right(regexp_extract(expression, '[-+*/][-+*/]'), 1) || ''' at position ' || strpos(expression, regexp_extract(expression, '[-+*/][-+*/]')) || '.'
 WHEN length(replace(expression, '(', '')) <> length(replace(expression, ')', '')) THEN 'Validation failed: Unmatched ''('' - parentheses are not balanced.'
 WHEN regexp_matches(expression, '/0([-+*/)]|$)') THEN 'Division by zero is not allowed.' ELSE 'ok' END"""

_VALUE = """CASE template WHEN 0 THEN ((a+b)*c)::DOUBLE WHEN 1 THEN a::DOUBLE/c-b WHEN 2 THEN (c*(a-b))::DOUBLE WHEN 3 THEN a::DOUBLE/nullif(b,0) WHEN 7 THEN (a+b)::DOUBLE WHEN 8 THEN a::DOUBLE END"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.expressions(spark, sf_dir).withColumn("tokens", F.split("raw", ""))


@query(_CLEANED + f"""
SELECT o_orderkey, expression, round(CASE template WHEN 0 THEN ((a+b)*c)::DOUBLE WHEN 1 THEN a::DOUBLE/c-b WHEN 2 THEN (c*(a-b))::DOUBLE WHEN 3 THEN a::DOUBLE/nullif(b,0) WHEN 7 THEN (a+b)::DOUBLE WHEN 8 THEN a::DOUBLE END, 6) AS result, {_STATUS} AS status FROM n""")
def expr_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = X.evaluate(_tokens(spark, sf_dir))
    return e.select("o_orderkey", "expression", F.round(F.col("result").cast("double"), 6).alias("result"), F.coalesce("error", F.lit("ok")).alias("status"))


@query(_CLEANED + " SELECT o_orderkey, cleaned FROM n")
def expr_clean(spark, sf_dir):
    return _tokens(spark, sf_dir).select("o_orderkey", F.array_join(X.clean(F.col("tokens")), "").alias("cleaned"))


@query(_CLEANED + " SELECT o_orderkey, expression FROM n WHERE expression <> cleaned")
def expr_implicit_mul(spark, sf_dir):
    c = _tokens(spark, sf_dir).withColumn("cleaned", F.array_join(X.clean(F.col("tokens")), ""))
    return c.select("o_orderkey", "cleaned", X.multiply(F.col("cleaned")).alias("expression")).filter("expression <> cleaned").drop("cleaned")


@query(_CLEANED + f", s AS (SELECT *, {_STATUS} AS status FROM n) SELECT o_orderkey, CASE WHEN starts_with(status, 'Validation failed: ') THEN substr(status, 20) ELSE 'OK' END AS status FROM s")
def expr_validate(spark, sf_dir):
    c = _tokens(spark, sf_dir).withColumn("e", X.multiply(F.array_join(X.auto_correct(X.clean(F.col("tokens"))), "")))
    return c.select("o_orderkey", F.coalesce(X.validation_error(F.col("e")), F.lit("OK")).alias("status"))


@query(_CLEANED + f", s AS (SELECT *, {_STATUS} AS status FROM n) SELECT o_orderkey, CASE WHEN starts_with(status, 'Validation failed: ') THEN substr(status, 20) ELSE 'OK' END AS status FROM s")
def expr_validate_all(spark, sf_dir):
    """expr_validate on all ten forms."""
    c = _tokens(spark, sf_dir).withColumn("e", X.multiply(F.array_join(X.auto_correct(X.clean(F.col("tokens"))), "")))
    return c.select("o_orderkey", F.coalesce(X.validation_error(F.col("e")), F.lit("OK")).alias("status"))


@query(_CLEANED + f" SELECT template, {_STATUS} = 'ok' AS ok, count(*) AS n FROM n GROUP BY ALL")
def expr_status_counts(spark, sf_dir):
    return X.evaluate(_tokens(spark, sf_dir)).groupBy("template", F.col("error").isNull().alias("ok")).agg(F.count("*").alias("n"))


@query(D.with_("exprs") + " SELECT o_orderkey, (length(raw) - length(replace(raw, '(', '')) - length(raw) + length(replace(raw, ')', '')))::BIGINT AS depth FROM exprs")
def expr_paren_depth(spark, sf_dir):
    return D.expressions(spark, sf_dir).select("o_orderkey", X.depth(F.col("raw")).cast("long").alias("depth"))


@query(_CLEANED + f""", s AS (SELECT *, {_STATUS} AS status, {_VALUE} AS value, o_orderkey // 40 AS image_id FROM n)
SELECT image_id, count(*) AS n_lines, CASE WHEN count(*) = 1 THEN min(expression) ELSE 'Detected ' || count(*) || ' lines' END AS expression,
 CASE WHEN count(*) > 1 THEN count(*) FILTER (status = 'ok') || '/' || count(*) || ' lines evaluated successfully' WHEN min(status) <> 'ok' THEN NULL WHEN regexp_full_match(min(expression), '[0-9]+') THEN min(expression)
  WHEN min(value) = floor(min(value)) THEN min(value)::BIGINT::VARCHAR ELSE min(value)::VARCHAR END AS result FROM s GROUP BY image_id""")
def line_summary(spark, sf_dir):
    e = X.evaluate(_tokens(spark, sf_dir)).withColumn("image_id", F.floor(F.col("o_orderkey") / 40))
    return X.line_summary(e)


@query(_CLEANED + f""", s AS (SELECT *, {_STATUS} AS status, {_VALUE} AS value, o_orderkey // 40 AS image_id FROM n)
SELECT image_id, count(*) AS n_lines, CASE WHEN count(*) = 1 THEN min(expression) ELSE 'Detected ' || count(*) || ' lines' END AS expression,
 CASE WHEN count(*) = 1 THEN round(min(value), 6) END AS value,
 CASE WHEN count(*) > 1 THEN count(*) FILTER (status = 'ok') || '/' || count(*) || ' lines evaluated successfully' END AS summary FROM s GROUP BY image_id""")
def line_summary_values(spark, sf_dir):
    """line_summary with the operator's result of every single-line image, as a rounded double."""
    e = X.evaluate(_tokens(spark, sf_dir)).withColumn("image_id", F.floor(F.col("o_orderkey") / 40))
    one = F.col("n_lines") == 1
    return X.line_summary(e).withColumns({"value": F.round(F.when(one, F.col("result")).cast("double"), 6), "summary": F.when(~one, F.col("result"))}).drop("result")


# --- boxes

_ROWS = D.with_("glyphs") + """,
m AS (SELECT *, y + h/2.0 AS cy, greatest(10, floor(median(h) OVER (PARTITION BY image_id) * 0.6)) AS snap FROM glyphs),
l AS (SELECT *, CASE WHEN cy - lag(cy) OVER (PARTITION BY image_id ORDER BY cy, glyph_id) > snap THEN 1 ELSE 0 END AS nw FROM m),
r AS (SELECT *, (sum(nw) OVER (PARTITION BY image_id ORDER BY cy, glyph_id ROWS UNBOUNDED PRECEDING))::BIGINT AS line FROM l)"""
_INSIDE = "b.x >= a.x - 1 AND b.y >= a.y - 1 AND b.x + b.w <= a.x + a.w + 1 AND b.y + b.h <= a.y + a.h + 1"


@query(D.with_("glyphs") + " SELECT image_id, count(*) AS n, median(w) AS med_w, median(h) AS med_h, median(w*h) AS med_area, round(stddev_pop(w), 6) AS std_w, round(median(w / greatest(1, h)), 6) AS med_aspect FROM glyphs GROUP BY image_id")
def box_medians(spark, sf_dir):
    return B.medians(D.glyphs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("std_w", "med_aspect")})


@query(_ROWS + " SELECT image_id, glyph_id, line FROM r")
def row_islands(spark, sf_dir):
    return B.rows(D.glyphs(spark, sf_dir)).select("image_id", "glyph_id", "line")


@query(_ROWS + " SELECT image_id, glyph_id, row_number() OVER (PARTITION BY image_id ORDER BY line, x, glyph_id) AS place FROM r")
def row_col_order(spark, sf_dir):
    return B.reading_order(D.glyphs(spark, sf_dir)).select("image_id", "glyph_id", "place")


@query(D.with_("glyphs") + f' SELECT a.image_id, b.glyph_id AS "inner", a.glyph_id AS "outer" FROM glyphs a JOIN glyphs b ON a.image_id = b.image_id AND a.glyph_id <> b.glyph_id AND {_INSIDE}')
def contained_boxes(spark, sf_dir):
    return B.contained(D.glyphs(spark, sf_dir))


@query(D.with_("glyphs") + f""",
m AS (SELECT *, w*h AS area, median(w) OVER (PARTITION BY image_id) AS mw, median(h) OVER (PARTITION BY image_id) AS mh, median(w*h) OVER (PARTITION BY image_id) AS ma FROM glyphs),
p AS (SELECT a.glyph_id AS o, b.glyph_id AS i, a.w*a.h AS oa FROM glyphs a JOIN glyphs b ON a.image_id = b.image_id AND a.glyph_id <> b.glyph_id AND {_INSIDE}),
hs AS (SELECT o, count(*) AS n FROM p GROUP BY o), hd AS (SELECT i, min(oa) AS lo FROM p GROUP BY i)
SELECT image_id, glyph_id FROM m LEFT JOIN hs ON glyph_id = o LEFT JOIN hd ON glyph_id = i
WHERE NOT coalesce(n >= 2 AND (w >= greatest(72, mw*1.6) OR h >= greatest(72, mh*1.4) OR area >= greatest(1800, ma*2)), false)
  AND NOT coalesce(area <= least(greatest(900, ma*0.45), lo*0.38) AND (w <= greatest(18, mw*0.42) OR h <= greatest(24, mh*0.42)), false)""")
def wrapper_removal(spark, sf_dir):
    return B.without_wrappers(D.glyphs(spark, sf_dir)).select("image_id", "glyph_id")


@query(D.with_("glyphs") + """ SELECT image_id, glyph_id FROM glyphs a WHERE NOT EXISTS (SELECT 1 FROM glyphs b WHERE a.image_id = b.image_id AND b.glyph_id < a.glyph_id
 AND greatest(0, least(a.x+a.w, b.x+b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y+a.h, b.y+b.h) - greatest(a.y, b.y)) >= 0.72 * least(a.w*a.h, b.w*b.h))""")
def overlap_anti(spark, sf_dir):
    return B.clear_of(D.glyphs(spark, sf_dir)).select("image_id", "glyph_id")


@query(D.with_("glyphs") + """, m AS (SELECT *, median(w) OVER (PARTITION BY image_id) AS mw, median(h) OVER (PARTITION BY image_id) AS mh, median(w*h) OVER (PARTITION BY image_id) AS ma FROM glyphs)
SELECT image_id, glyph_id FROM m WHERE NOT (w*h < 12 AND w*h < ma*0.08) AND NOT (w/greatest(1,h) >= 6 AND w >= greatest(180, mw*1.4) AND h <= greatest(18, mh*0.65))
 AND NOT ((x <= 20 OR y <= 6 OR x+w >= 980 OR y+h >= 294) AND w*h < greatest(12, ma*0.12) AND w < mw*0.75 AND h < mh*0.75)""")
def box_filter(spark, sf_dir):
    return B.size_filter(D.glyphs(spark, sf_dir), WIDTH, HEIGHT).select("image_id", "glyph_id")


@query(D.with_("glyphs") + " SELECT image_id, count(*) FILTER (w >= 27 AND h <= 42) AS n_line_like, round(avg((w >= 27 AND h <= 42)::INT), 6) AS line_share FROM glyphs GROUP BY image_id")
def line_like_share(spark, sf_dir):
    """On pictures of 150 x 1400, where a line is at least 27 wide and at most 42 high."""
    return B.line_share(D.glyphs(spark, sf_dir), 150, 1400).withColumn("line_share", F.round("line_share", 6))


_SCORES = D.with_("glyphs") + """,
m AS (SELECT *, ((glyph_id*13)%60/100.0)::DOUBLE AS fill, median(w) OVER (PARTITION BY image_id) AS mw, median(h) OVER (PARTITION BY image_id) AS mh, median(w*h) OVER (PARTITION BY image_id) AS ma FROM glyphs),
g AS (SELECT image_id, count(*) AS n, first(mw) AS mw, first(mh) AS mh, (max(x+w)-min(x))/1000.0::DOUBLE AS span, stddev_pop(y+h/2.0) AS sy, stddev_pop(w) AS sw, stddev_pop(h) AS sh, median(fill) AS fill, (image_id%10/10.0)::DOUBLE AS region,
 avg((w/greatest(1,h) < 0.20)::INT) AS slim, avg((w <= greatest(18, mw*0.42) OR h <= greatest(24, mh*0.42) OR w*h <= greatest(180, ma*0.28))::INT) AS tiny,
 count(*) FILTER (w >= 180 AND h <= 18) AS lines, count(*) FILTER (x <= 1 OR y <= 1 OR x+w >= 999 OR y+h >= 299) AS touch FROM m GROUP BY image_id HAVING count(*) >= 2),
s AS (SELECT image_id, n, span AS span_ratio, least(18.0, n*2.2::DOUBLE) + least(5.0, span*6.0) + least(4.0, mh/300*30.0) + greatest(0.0, 2.5 - sy/greatest(1,mh)*4.0) + least(2.0, fill*4.0) - lines*3.5 - tiny*22.0
 - greatest(0.0, sw/greatest(1,mw)-0.9::DOUBLE)*4.0 - greatest(0.0, sh/greatest(1,mh)-0.75::DOUBLE)*4.0 - greatest(0.0, 0.36::DOUBLE-mw/greatest(1,mh))*18.0 - greatest(0.0, slim-0.20::DOUBLE)*22.0 - touch*0.8::DOUBLE - greatest(0.0, region-0.45::DOUBLE)*10.0 AS score FROM g)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = D.glyphs(spark, sf_dir).withColumns({"fill": (F.col("glyph_id") * 13 % 60 / 100.0).cast("double"), "region_frac": (F.col("image_id") % 10 / 10.0).cast("double")})
    return B.candidate_scores(g, WIDTH, HEIGHT).withColumns({"span_ratio": F.round("span_ratio", 6), "score": F.round("score", 6)})


@query(_SCORES + " SELECT image_id, n, round(span_ratio, 6) AS span_ratio, round(score, 6) AS score FROM s")
def candidate_score(spark, sf_dir):
    return _candidates(spark, sf_dir)


@query(_SCORES + ", k AS (SELECT image_id % 10 AS batch, image_id, round(score, 6) AS score, row_number() OVER (PARTITION BY image_id % 10 ORDER BY round(score, 6) DESC, n DESC, image_id) AS k FROM s) SELECT batch, image_id, score FROM k WHERE k = 1")
def best_candidate(spark, sf_dir):
    s = _candidates(spark, sf_dir).withColumn("batch", F.col("image_id") % 10)
    k = F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("score"), F.desc("n"), "image_id"))
    return s.withColumn("k", k).filter("k = 1").select("batch", "image_id", "score")


@query(_ROWS + """, p AS (SELECT image_id, line, count(*) AS n, sum(w*h)::BIGINT AS area FROM r GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, area DESC, line) AS k, sum(n) OVER (PARTITION BY image_id) AS total FROM p)
SELECT image_id, line, n, area FROM k WHERE k = 1 AND n >= greatest(3, round_even(total/2.0, 0))""")
def dominant_row(spark, sf_dir):
    return B.dominant_row(D.glyphs(spark, sf_dir))


@query(D.with_("glyphs") + """, c AS (SELECT image_id, y+h/2.0 AS cy, greatest(18, floor(median(h) OVER (PARTITION BY image_id)*0.70)) AS snap FROM glyphs), st AS (SELECT image_id, cy-lag(cy) OVER (PARTITION BY image_id ORDER BY cy) AS d, snap FROM c), rw AS (SELECT image_id, count(*) FILTER (d > snap)+1 AS nr FROM st GROUP BY image_id),
g AS (SELECT image_id, count(*) AS n, median(w) AS mw, stddev_pop(w) AS sw, count(*) FILTER (w >= 36 AND h <= 33) AS lines, avg((w/greatest(1, h) < 0.18)::INT) AS slim FROM glyphs GROUP BY image_id)
SELECT image_id, CASE WHEN n < 2 THEN 'Too few rects (' || n || ' < 2)' WHEN nr > 2 THEN 'Too many rows (' || nr || ')' WHEN lines >= greatest(2, round_even(n*0.50, 0)) THEN 'Line dominated (' || lines || '/' || n || ')' WHEN n >= 18 AND slim >= 0.55 THEN 'Vertical-guide dominated (' || printf('%.2f', slim) || ')'
 WHEN sw > greatest(18.0, mw*2.2) THEN 'Widths too inconsistent' ELSE 'Valid generic region result' END AS reason FROM g JOIN rw USING (image_id)""")
def generic_validation(spark, sf_dir):
    return B.validation(D.glyphs(spark, sf_dir), 200, 1100)


@query(D.with_("glyphs") + """, g AS (SELECT image_id, count(*) AS n, list_sort(list(w)) AS ws FROM glyphs GROUP BY image_id)
SELECT image_id, n::INT AS n, list_median(ws[(n//4)+1 : least(n-1, (3*n)//4)+1])::DOUBLE AS mid_w FROM g""".replace("list_median(", "list_aggregate(").replace("+1])::DOUBLE", "+1], 'median')::DOUBLE"))
def iqr_median_width(spark, sf_dir):
    return B.middle_width(D.glyphs(spark, sf_dir))


@query(D.with_("glyphs") + """, o AS (SELECT *, CASE WHEN x - max(x+w) OVER (PARTITION BY image_id ORDER BY x, glyph_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 10 THEN 0 ELSE 1 END AS nw FROM glyphs),
i AS (SELECT *, sum(nw) OVER (PARTITION BY image_id ORDER BY x, glyph_id ROWS UNBOUNDED PRECEDING) AS isle FROM o)
SELECT image_id, min(x) AS x0, max(x+w) AS x1, count(*) AS n FROM i GROUP BY image_id, isle""")
def interval_merge(spark, sf_dir):
    return B.merged_intervals(D.glyphs(spark, sf_dir), 10)


@query(_ROWS + ", a AS (SELECT image_id, line, glyph_id, lead(glyph_id) OVER w AS next_id, lead(x) OVER w - (x + w) AS gap FROM r WINDOW w AS (PARTITION BY image_id, line ORDER BY x, glyph_id)) SELECT * FROM a WHERE next_id IS NOT NULL")
def adjacent_pairs(spark, sf_dir):
    return B.adjacent(D.glyphs(spark, sf_dir))


@query(D.with_("glyphs") + """, m AS (SELECT *, median(w) OVER (PARTITION BY image_id) AS mw, median(h) OVER (PARTITION BY image_id) AS mh, count(*) OVER (PARTITION BY image_id) AS n FROM glyphs)
SELECT image_id, glyph_id, CASE WHEN w/greatest(1.0,mw) < 1.55 THEN 1 WHEN w/greatest(1.0,mw) < 2.45 THEN 2 WHEN w/greatest(1.0,mw) < 3.45 THEN 3 ELSE round_even(w/greatest(1.0,mw), 0)::INT END AS n_chars FROM m WHERE n >= 2 AND w >= mw*1.7 AND h >= mh*0.5""")
def wide_boxes(spark, sf_dir):
    return B.split_counts(D.glyphs(spark, sf_dir))


# --- scores and metrics

_SOFT = D.with_("scores") + """,
e AS (SELECT vec_id, label, logits, list_transform(logits, lambda v: exp(v - list_max(logits))) AS ex FROM scores),
p AS (SELECT vec_id, label, logits, list_transform(ex, lambda v: v / list_sum(ex)) AS p FROM e),
q AS (SELECT vec_id, label AS truth, (list_position(logits, list_max(logits)) - 1)::INT AS pred, list_reverse_sort(p) AS s FROM p),
d AS (SELECT vec_id, truth, pred, s[1] AS conf, s[1] - s[2] AS margin FROM q)"""
_CLASS = _SOFT + """,
l AS (SELECT truth AS label FROM d UNION SELECT pred FROM d),
c AS (SELECT label, (SELECT count(*) FROM d WHERE truth = label) AS support, (SELECT count(*) FROM d WHERE pred = label) AS said, (SELECT count(*) FROM d WHERE pred = label AND truth = label) AS hit FROM l),
pr AS (SELECT label, support, CASE WHEN said = 0 THEN 0.0 ELSE hit::DOUBLE/said END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE hit::DOUBLE/support END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2*precision*recall/(precision+recall) END AS f1 FROM pr)"""


def _predicted(spark, sf_dir):
    return M.predicted(D.scores(spark, sf_dir))


@query(_SOFT + """, x AS (SELECT vec_id, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS idx FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, idx DESC) AS rank FROM x)
SELECT vec_id, rank::INT AS rank, (['0','1','2','3','4','5','6','7','8','9','+','-','*','/','(',')'])[idx+1] AS char, round(v, 6) AS conf FROM k WHERE rank <= 5""")
def softmax_topk(spark, sf_dir):
    return M.topk_rows(D.scores(spark, sf_dir), 5)


@query(_SOFT + " SELECT vec_id, pred, round(conf, 6) AS conf FROM d")
def argmax_label(spark, sf_dir):
    return _predicted(spark, sf_dir).select("vec_id", "pred", F.round("conf", 6).alias("conf"))


@query(_SOFT + " SELECT vec_id, round(margin, 6) AS margin FROM d")
def top2_margin(spark, sf_dir):
    return _predicted(spark, sf_dir).select("vec_id", F.round("margin", 6).alias("margin"))


@query(_SOFT + " SELECT truth, pred, count(*) AS n FROM d GROUP BY ALL")
def confusion_long(spark, sf_dir):
    return M.confusion(_predicted(spark, sf_dir))


@query(D.with_("binary_eval") + " SELECT truth, count(*) FILTER (pred = 0) AS pred_0, count(*) FILTER (pred = 1) AS pred_1 FROM binary_eval GROUP BY truth")
def confusion_pivot(spark, sf_dir):
    return M.confusion_wide(D.binary_eval(spark, sf_dir), (0, 1))


@query(_CLASS + " SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f")
def per_class_prf(spark, sf_dir):
    return M.per_class(_predicted(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(_CLASS + """ SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1, round(sum(precision*support)/sum(support), 6) AS weighted_precision,
 round(sum(f1*support)/sum(support), 6) AS weighted_f1, round(sum(recall*support)/sum(support), 6) AS accuracy, round(sum(recall*support)/sum(support), 6) AS weighted_recall,
 (SELECT round(sum(hit)/sum(said), 6) FROM c) AS micro_precision, (SELECT round(sum(hit)/sum(support), 6) FROM c) AS micro_recall, (SELECT round(2*sum(hit)/(sum(said)+sum(support)), 6) FROM c) AS micro_f1 FROM f""")
def macro_metrics(spark, sf_dir):
    a = M.averages(_predicted(spark, sf_dir))
    return a.select(*[F.round(c, 6).alias(c) for c in a.columns])


@query(_CLASS + """ SELECT 'target' AS name, round(coalesce(avg(f1), 0), 6) AS macro_f1, round(coalesce(avg(recall), 0), 6) AS macro_recall FROM f WHERE label IN (2, 3)
UNION ALL SELECT 'boundary', round(coalesce(avg(f1), 0), 6), round(coalesce(avg(recall), 0), 6) FROM f WHERE label IN (1, 14, 15)""")
def subset_macro(spark, sf_dir):
    return M.subset_macro(_predicted(spark, sf_dir), {"target": (2, 3), "boundary": (1, 14, 15)}).withColumns({c: F.round(c, 6) for c in ("macro_f1", "macro_recall")})


@query(_CLASS + """, t AS (SELECT coalesce(avg(f1),0) AS tf, coalesce(avg(recall),0) AS tr FROM f WHERE label IN (2,3)), b AS (SELECT coalesce(avg(f1),0) AS bf, coalesce(avg(recall),0) AS br FROM f WHERE label IN (1,14,15)), a AS (SELECT avg((truth=pred)::INT) AS acc FROM d)
SELECT round(tf, 6) AS target_f1, round(bf, 6) AS boundary_f1, round(acc, 6) AS accuracy, round(0.40::DOUBLE*tf + 0.15::DOUBLE*tr + 0.20::DOUBLE*bf + 0.10::DOUBLE*br + 0.15::DOUBLE*acc, 6) AS priority FROM t, b, a""")
def priority_score(spark, sf_dir):
    r = M.priority_row(_predicted(spark, sf_dir), (2, 3), (1, 14, 15))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@query(D.with_("feedback") + " SELECT action, label_idx, count(*) AS n FROM feedback GROUP BY ROLLUP (action, label_idx)")
def label_counts_rollup(spark, sf_dir):
    return M.label_rollup(D.feedback(spark, sf_dir))


@query("""WITH l AS (SELECT o_custkey AS series, o_orderkey AS step, o_totalprice AS value FROM orders), b AS (SELECT *, max(value) OVER (PARTITION BY series ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l)
SELECT series, step, greatest(value, coalesce(before, value)) AS best, coalesce(value > before + 1e-6, true) AS is_best FROM b""")
def running_best(spark, sf_dir):
    log = D.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("value"))
    return M.running_best(log).drop("value")


# --- feedback

def _vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(labels.VOCABULARY)], "char string, idx long")


@query(D.with_("vocab", "feedback") + " SELECT event_id, analysis_id, action, char FROM feedback LEFT JOIN vocab ON label_idx = idx")
def feedback_lookup(spark, sf_dir):
    return K.lookup(D.feedback(spark, sf_dir), _vocabulary(spark))


@query(D.with_("feedback") + """, k AS (SELECT *, row_number() OVER (PARTITION BY analysis_id, label_idx ORDER BY saved_at DESC, event_id DESC) AS k FROM feedback WHERE action = 'corrected')
SELECT event_id, analysis_id, action FROM k WHERE k = 1 UNION ALL SELECT event_id, analysis_id, action FROM feedback WHERE action = 'rejected'""")
def feedback_dedupe(spark, sf_dir):
    return K.last_writes(D.feedback(spark, sf_dir)).select("event_id", "analysis_id", "action")


@query(D.with_("feedback") + " SELECT analysis_id, label_idx FROM feedback WHERE action = 'corrected' INTERSECT SELECT analysis_id, label_idx FROM feedback WHERE action = 'rejected'")
def feedback_conflicts(spark, sf_dir):
    return K.conflicts(D.feedback(spark, sf_dir))


@query(D.with_("feedback") + """, c AS (SELECT analysis_id, count(*) FILTER (action='corrected') AS c, count(*) FILTER (action='rejected') AS r FROM feedback GROUP BY analysis_id),
t AS (SELECT *, c || ' correction' || CASE WHEN c = 1 THEN '' ELSE 's' END AS ct, r || ' rejection' || CASE WHEN r = 1 THEN '' ELSE 's' END AS rt FROM c)
SELECT analysis_id, CASE WHEN c > 0 AND r > 0 THEN 'Saved ' || ct || ' and ' || rt || '.' WHEN c > 0 THEN 'Saved ' || ct || '.' ELSE 'Saved ' || rt || '.' END AS message FROM t""")
def feedback_summary(spark, sf_dir):
    return K.messages(D.feedback(spark, sf_dir))


@query(D.with_("glyphs") + " SELECT image_id, floor(avg(conf)*100+0.5)::BIGINT AS avg_percent, count(*) FILTER (conf < 0.8) AS n_low FROM glyphs GROUP BY image_id")
def confidence_summary(spark, sf_dir):
    return K.confidence_summary(D.glyphs(spark, sf_dir))


@query(_SOFT + """, x AS (SELECT vec_id, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS idx FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, idx DESC) AS rank FROM x)
SELECT vec_id, string_agg((['0','1','2','3','4','5','6','7','8','9','+','-','*','/','(',')'])[idx+1] || ' ' || floor(round_even(v, 6)*100+0.5)::BIGINT || '%', ' · ' ORDER BY rank) AS summary FROM k WHERE rank <= 5 GROUP BY vec_id""")
def topk_json(spark, sf_dir):
    return K.topk_text(M.topk_rows(D.scores(spark, sf_dir), 5))


@query(D.with_("feedback") + " SELECT time_bucket(INTERVAL 1 DAY, saved_at) AS win_start, action, count(*) AS n FROM feedback GROUP BY ALL")
def feedback_windows(spark, sf_dir):
    return K.windowed_counts(D.feedback(spark, sf_dir)).withColumn("win_start", F.col("win_start").cast("timestamp_ntz"))


@query(ORACLE["feedback_windows"])
def feedback_stream(spark, sf_dir):
    return counted_stream(spark, sf_dir).withColumn("win_start", F.col("win_start").cast("timestamp_ntz"))


# --- context

def _sequence(spark, sf_dir):
    # a glyph's options and readings cost as much as some plain rows
    return B.reading_order(D.dealt(D.glyphs(spark, sf_dir), "image_id", 10)).select("image_id", "place", "char", "conf")


_SEQ = _ROWS + ", s AS (SELECT image_id, char, conf, row_number() OVER (PARTITION BY image_id ORDER BY line, x, glyph_id) AS place FROM r)"


@query(D.with_("glyphs") + " SELECT CASE WHEN char BETWEEN '0' AND '9' THEN 'digit' WHEN char IN ('+','-','*','/') THEN 'operator' ELSE 'unknown' END AS kind, count(*) AS n FROM glyphs GROUP BY ALL")
def char_types(spark, sf_dir):
    return D.glyphs(spark, sf_dir).groupBy(labels.char_type(F.col("char")).alias("kind")).agg(F.count("*").alias("n"))


@query(_SEQ + " SELECT image_id, char, CASE WHEN conf < 0.82 AND char = '-' THEN '1' WHEN conf < 0.82 AND char = '/' THEN '7' WHEN conf < 0.82 AND char = '+' THEN '4' ELSE char END AS corrected FROM s WHERE place = 1")
def leading_flip(spark, sf_dir):
    return C.leading(_sequence(spark, sf_dir))


@query(_SEQ + """, p AS (SELECT *, lag(char) OVER w AS prev, lag(conf) OVER w AS pc FROM s WINDOW w AS (PARTITION BY image_id ORDER BY place))
SELECT image_id, place, prev AS "left", char AS "right", CASE WHEN conf <= pc THEN place ELSE place - 1 END AS weaker FROM p WHERE char IN ('+','-','*','/') AND prev IN ('+','-','*','/')""")
def double_operator(spark, sf_dir):
    return C.double_operators(_sequence(spark, sf_dir))


@query()
def correct_sequence(spark, sf_dir):
    return C.correct_sequences(_sequence(spark, sf_dir))


@query()
def beam_select(spark, sf_dir):
    s = _sequence(spark, sf_dir)
    other = s.withColumn("char", F.translate("char", "0123456789+-*/()", "94-()/7*+1653928")).withColumn("conf", F.col("conf") * 0.9)
    return C.read_lines(s.unionByName(other))


# --- pixels

@query(D.with_("pixels") + " SELECT glyph_id, y, count(*) FILTER (v >= 128) AS n_ink FROM pixels GROUP BY ALL")
def pixel_projection(spark, sf_dir):
    return P.projections(D.pixels(spark, sf_dir))


@query(D.with_("pixels") + " SELECT glyph_id, min(x) AS x0, min(y) AS y0, max(x)+1 AS x1, max(y)+1 AS y1, count(*) AS n_ink FROM pixels WHERE v >= 128 GROUP BY glyph_id")
def pixel_bbox(spark, sf_dir):
    return P.ink_box(D.pixels(spark, sf_dir))


_PART = ", ".join(f"round(coalesce(avg(CASE WHEN {c} THEN (v>=128)::INT END), 0), 6) AS {n}" for n, c in (
    ("fill", "true"), ("left_half", "x<14"), ("right_half", "x>=14"), ("top_half", "y<14"), ("bottom_half", "y>=14"), ("center", "x BETWEEN 9 AND 18 AND y BETWEEN 9 AND 18"), ("center_row", "y BETWEEN 13 AND 15"),
    ("center_col", "x BETWEEN 13 AND 15"), ("diag_primary", "(x<14) = (y<14)"), ("diag_secondary", "(x<14) <> (y<14)")))


@query(D.with_("pixels") + f" SELECT glyph_id, {_PART} FROM pixels GROUP BY glyph_id")
def roi_features(spark, sf_dir):
    f = P.features(D.pixels(spark, sf_dir))
    return f.select("glyph_id", *[F.round(c, 6).alias(c) for c in f.columns[1:]])


@query(D.with_("pixels") + """, b AS (SELECT glyph_id, min(x) AS x0, min(y) AS y0, max(x)+1 AS x1, max(y)+1 AS y1 FROM pixels WHERE v >= 128 GROUP BY glyph_id)
SELECT glyph_id, round(avg((v>=128)::INT), 6) AS fill FROM pixels JOIN b USING (glyph_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY glyph_id""")
def fill_ratio(spark, sf_dir):
    p = D.pixels(spark, sf_dir)
    return P.fill_in_boxes(p, P.ink_box(p)).withColumn("fill", F.round("fill", 6))


@query(D.with_("pixels") + """, h AS (SELECT glyph_id, v, count(*) AS n FROM pixels GROUP BY ALL),
c AS (SELECT *, sum(n) OVER u AS n0, sum(n*v) OVER u AS s0, sum(n) OVER (PARTITION BY glyph_id) AS na, sum(n*v) OVER (PARTITION BY glyph_id) AS sa FROM h WINDOW u AS (PARTITION BY glyph_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
b AS (SELECT glyph_id, v, round(CASE WHEN na = n0 THEN 0 ELSE (s0*na - sa*n0)::DOUBLE * (s0*na - sa*n0)::DOUBLE / (n0::DOUBLE * (na - n0)::DOUBLE) END, 3) AS btw FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY glyph_id ORDER BY btw DESC, v) AS k FROM b) SELECT glyph_id, v AS threshold FROM k WHERE k = 1""")
def otsu_threshold(spark, sf_dir):
    return P.otsu(D.pixels(spark, sf_dir))


# --- shapes and lines

_FEATURES = """shape AS (SELECT o_orderkey AS glyph_id, o_custkey AS image_id, ((o_orderkey*101)%1000/1000.0)::DOUBLE AS conf, ((o_orderkey*7)%21/10.0)::DOUBLE AS aspect, ((o_orderkey*13)%100/100.0)::DOUBLE AS fill, ((o_orderkey*17)%100/100.0)::DOUBLE AS "left",
 ((o_orderkey*19)%100/100.0)::DOUBLE AS "right", ((o_orderkey*23)%100/100.0)::DOUBLE AS top, ((o_orderkey*29)%100/100.0)::DOUBLE AS bottom, ((o_orderkey*31)%100/100.0)::DOUBLE AS center, ((o_orderkey*37)%100/100.0)::DOUBLE AS center_row,
 ((o_orderkey*41)%100/100.0)::DOUBLE AS center_col, ((o_orderkey*43)%140/100.0)::DOUBLE AS diag_primary, ((o_orderkey*47)%140/100.0)::DOUBLE AS diag_secondary, ((o_orderkey*53)%3//2)::INT AS holes, (2+o_orderkey%27)::INT AS content_h, (2+o_orderkey%17)::INT AS content_w FROM orders)"""


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    hundredth = lambda m, n=100: (k * m % n / 100.0).cast("double")
    measures = {"fill": 13, "left": 17, "right": 19, "top": 23, "bottom": 29, "center": 31, "center_row": 37, "center_col": 41}
    return D.read(spark, sf_dir, "orders").select(
        k.alias("glyph_id"), F.col("o_custkey").alias("image_id"), (k * 101 % 1000 / 1000.0).cast("double").alias("conf"), (k * 7 % 21 / 10.0).cast("double").alias("aspect"), *[hundredth(m).alias(n) for n, m in measures.items()],
        hundredth(43, 140).alias("diag_primary"), hundredth(47, 140).alias("diag_secondary"), F.floor(k * 53 % 3 / 2).cast("int").alias("holes"), (2 + k % 27).cast("int").alias("content_h"), (2 + k % 17).cast("int").alias("content_w"))


@query(f"""WITH {_FEATURES}, c AS (SELECT *, CASE WHEN (glyph_id % 4) IN (0, 1) THEN conf * CASE WHEN aspect >= 2.5 OR (aspect BETWEEN 0.65 AND 1.55 AND center_row >= 0.55 AND fill >= 0.55) THEN 0.60::DOUBLE ELSE 1.0 END ELSE conf END AS rc,
 (['1','7','-','/'])[glyph_id%4+1] AS char FROM shape)
SELECT glyph_id, round(rc, 6) AS read_conf, CASE WHEN rc >= 0.75 THEN char WHEN char IN ('1','-') THEN CASE WHEN aspect >= 2.0 AND center_row >= 0.60 THEN '-' WHEN aspect < 0.8 AND fill >= 0.60 THEN '1' ELSE '-' END
 WHEN char IN ('7','/') THEN CASE WHEN top >= 0.10 THEN '7' WHEN aspect >= 1.8 THEN '/' ELSE '7' END END AS read FROM c""")
def dual_reading(spark, sf_dir):
    s = _shapes(spark, sf_dir).withColumns({"char": F.element_at(F.array(*[F.lit(c) for c in "17-/"]), (F.col("glyph_id") % 4 + 1).cast("int")), "symmetry": F.col("center_row"), "density": F.col("fill")})
    return L.dual_reading(s).select("glyph_id", F.round("read_conf", 6).alias("read_conf"), "read")


@query(_ROWS + """, g AS (SELECT image_id, line, count(*) AS n, count(*) FILTER (char BETWEEN '0' AND '9') AS d, count(*) FILTER (char IN ('+','-','*','/')) AS o, count(*) FILTER (char IN ('(',')')) AS p, avg(conf) AS c, sum(w*h) AS area,
 (max(x+w)-min(x))/greatest(1.0, max(y+h)-min(y))::DOUBLE AS aspect FROM r GROUP BY image_id, line), b AS (SELECT *, max(area) OVER (PARTITION BY image_id) AS best FROM g)
SELECT image_id, line, n, round(d*5.0+p*2.5+o*1.5+n*1.4::DOUBLE+c*2.5+least(3.0, area/greatest(1.0, best)::DOUBLE*3.0) - CASE WHEN n=1 AND o=1 THEN 10 ELSE 0 END - CASE WHEN n<=2 AND d=0 THEN 8 ELSE 0 END - CASE WHEN n<=2 AND o>=1 AND d+p<=1 THEN 5 ELSE 0 END
 - CASE WHEN aspect>=8 AND o>=1 AND d+p<=1 THEN 8 ELSE 0 END - CASE WHEN d=0 AND o>0 AND p=0 THEN 4 ELSE 0 END, 6) AS score FROM b""")
def line_score(spark, sf_dir):
    return L.line_scores(B.rows(D.glyphs(spark, sf_dir))).withColumn("score", F.round("score", 6))


@query()
def line_clusters(spark, sf_dir):
    return L.cluster(D.glyphs(spark, sf_dir), 28.0, 0.65)


@query(D.with_("binary_eval") + " SELECT count(*) AS n, round(avg((truth = pred)::INT), 6) AS accuracy, round(avg(CASE WHEN truth = 1 THEN pred END), 6) AS recall FROM binary_eval")
def case_accuracy(spark, sf_dir):
    hit = (F.col("truth") == F.col("pred")).cast("double")
    return D.binary_eval(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("truth") == 1, F.col("pred").cast("double"))), 6).alias("recall"))


from . import photos, reading, records, vision  # noqa: E402, F401  register their queries
