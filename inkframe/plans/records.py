"""Queries over records: labels, feedback requests, training rows, replays and reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import evaluation as E
from ..operators import expressions as X
from ..operators import feedback as K
from ..operators import metrics as M
from ..sources import derived as D
from .registry import query

_VOCAB = "(['0','1','2','3','4','5','6','7','8','9','+','-','*','/','(',')'])"
#: Spellings of labels that the label queries deal to the events.
SPELLINGS = [" plus", "minus ", "mul", "times", "x", "X", "div", "slash", "forward_slash", "÷", "lparen", "rparen", "×", ":", "7", "  ", "(", "ab", "a b", "é", "+", "-", "*", "/", ")"]
_SPELLED = "([" + ", ".join(f"'{s}'" for s in SPELLINGS) + "])"


def _spelled(k) -> F.Column:
    return F.element_at(F.array(*[F.lit(s) for s in SPELLINGS]), (k % len(SPELLINGS) + 1).cast("int"))


# --- labels

@query(f"""WITH s AS (SELECT event_id, trim({_SPELLED}[event_id % 25 + 1]) AS t FROM events),
l AS (SELECT *, CASE WHEN t = 'plus' THEN '+' WHEN t = 'minus' THEN '-' WHEN t IN ('mul', 'times', 'x', 'X') THEN '*' WHEN t IN ('div', 'slash', 'forward_slash', '÷') THEN '/' WHEN t = 'lparen' THEN '(' WHEN t = 'rparen' THEN ')' ELSE t END AS label FROM s)
SELECT event_id, label,
 CASE WHEN t IN ('x', 'X', '×') THEN '*' WHEN t IN ('÷', ':') THEN '/' ELSE t END AS page_label,
 CASE WHEN t = 'plus' THEN '+' WHEN t = 'minus' THEN '-' WHEN t IN ('mul', 'times') THEN '*' WHEN t IN ('div', 'slash', 'forward_slash') THEN '/' WHEN t = 'lparen' THEN '(' WHEN t = 'rparen' THEN ')' WHEN t <> '' THEN t END AS folder_label,
 CASE label WHEN '+' THEN 'plus' WHEN '-' THEN 'minus' WHEN '*' THEN 'mul' WHEN '/' THEN 'div' WHEN '(' THEN 'lparen' WHEN ')' THEN 'rparen' ELSE CASE WHEN regexp_full_match(label, '[\\p{{L}}\\p{{N}}]+') THEN label ELSE 'unknown' END END AS token FROM l""")
def label_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _spelled(F.col("event_id"))
    return D.read(spark, sf_dir, "events").select(
        "event_id", labels.normal_label(raw).alias("label"), labels.normal_label(raw, labels.PAGE_ALIASES).alias("page_label"), labels.folder_label(raw).alias("folder_label"), labels.label_token(raw).alias("token"))


@query(f"""WITH e AS (SELECT event_id, lag({_VOCAB}[event_id % 16 + 1]) OVER (PARTITION BY user_id ORDER BY event_id) AS before, '<' || event_type || '>&"' || props || chr(39) AS t FROM events)
SELECT event_id, CASE WHEN before IS NULL OR before IN ('+', '-', '*', '/') THEN 'expected_digit' ELSE 'expected_any' END AS expected,
 replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS escaped FROM e""")
def text_for_pages(spark, sf_dir):
    """What type of character should follow, and texts with the characters escaped that html gives a meaning."""
    e = D.read(spark, sf_dir, "events")
    before = F.lag(D.vocabulary_at(F.col("event_id") % 16)).over(Window.partitionBy("user_id").orderBy("event_id"))
    text = F.concat(F.lit("<"), "event_type", F.lit('>&"'), "props", F.lit("'"))
    return e.select("event_id", labels.expected_type(before).alias("expected"), labels.escaped(text).alias("escaped"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || 'Z' AS iso,
 strftime(ts, '%Y%m%dT%H%M%S') || '_' || substr(md5(event_id::VARCHAR), 1, 8) AS analysis_id FROM events""")
def times_and_ids(spark, sf_dir):
    f = D.feedback(spark, sf_dir)
    return f.select("event_id", K.utc_iso(F.col("saved_at")).alias("iso"), K.analysis_id(F.col("saved_at"), F.md5(F.col("event_id").cast("string"))).alias("analysis_id"))


# --- feedback requests

_ITEMS = f"""items AS (SELECT user_id AS analysis_id, event_id AS ord, CASE WHEN event_type IN ('purchase','signup') THEN 'rejected' ELSE 'corrected' END AS action,
 CASE WHEN event_id % 97 = 0 THEN ' ' WHEN event_id % 89 = 0 THEN 'c9' WHEN event_id % 83 = 0 THEN ' c0 ' WHEN event_type IN ('purchase','signup') THEN 'c' || (3 + event_id % 2) ELSE 'c' || (event_id % 3) END AS character_id,
 CASE WHEN event_type IN ('purchase','signup') THEN NULL WHEN event_id % 101 = 0 THEN '=' WHEN event_id % 103 = 0 THEN NULL ELSE (['mul','7','(','slash','+','0'])[event_id % 6 + 1] END AS corrected FROM events),
chars AS (SELECT user_id AS analysis_id, 'c' || k AS character_id, {_VOCAB}[(user_id*3+k)%16+1] AS char, ((user_id*7+k*13)%10000/10000.0)::DOUBLE AS conf, {_VOCAB}[(user_id+k)%16+1] AS raw_char FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(range(5)) AS k)),
an AS (SELECT DISTINCT user_id AS analysis_id, 'scan_' || user_id || '.png' AS source_filename FROM events WHERE user_id % 7 <> 0),
n AS (SELECT analysis_id, ord, action, trim(character_id) AS character_id, CASE coalesce(corrected, '') WHEN 'mul' THEN '*' WHEN 'slash' THEN '/' ELSE coalesce(corrected, '') END AS label FROM items),
b AS (SELECT n.*, CASE WHEN n.character_id = '' THEN CASE action WHEN 'corrected' THEN 'A correction is missing character_id.' ELSE 'A rejection is missing character_id.' END
 WHEN action = 'corrected' AND NOT list_contains({_VOCAB}, label) THEN 'Unsupported correction label: ' || CASE label WHEN '' THEN '(empty)' ELSE label END
 WHEN c.character_id IS NULL THEN 'Unknown character_id: ' || n.character_id END AS bad FROM n LEFT JOIN chars c ON n.analysis_id = c.analysis_id AND n.character_id = c.character_id),
fb AS (SELECT analysis_id, bad FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY action, ord) AS k FROM b WHERE bad IS NOT NULL) WHERE k = 1),
bo AS (SELECT DISTINCT analysis_id FROM (SELECT analysis_id, character_id FROM n WHERE action = 'corrected' INTERSECT SELECT analysis_id, character_id FROM n WHERE action = 'rejected')),
v AS (SELECT a.analysis_id, CASE WHEN an.analysis_id IS NULL THEN 'The selected analysis could not be found.' WHEN fb.bad IS NOT NULL THEN fb.bad WHEN bo.analysis_id IS NOT NULL THEN 'A character cannot be corrected and rejected at the same time.' END AS error
 FROM (SELECT DISTINCT analysis_id FROM items) a LEFT JOIN an USING (analysis_id) LEFT JOIN fb USING (analysis_id) LEFT JOIN bo USING (analysis_id))"""
_SAVED = _ITEMS + """,
tok AS (SELECT unnest(['+','-','*','/','(',')']) AS c, unnest(['plus','minus','mul','div','lparen','rparen']) AS t),
kept AS (SELECT * FROM (SELECT n.*, row_number() OVER (PARTITION BY n.analysis_id, n.character_id, action ORDER BY ord DESC) AS k FROM n JOIN v ON n.analysis_id = v.analysis_id WHERE v.error IS NULL) WHERE k = 1 OR action = 'rejected'),
sv AS (SELECT kept.analysis_id, source_filename, kept.character_id, chars.char AS predicted_char, CASE WHEN action = 'corrected' THEN label END AS corrected_char, round_even(conf, 3) AS confidence, raw_char, action, ord,
 CASE WHEN action = 'corrected' THEN 'corrections/' || coalesce(lt.t, label) || '/' || kept.analysis_id || '_' || kept.character_id || '_pred-' || coalesce(pt.t, chars.char) || '_label-' || coalesce(lt.t, label) || '.png'
  ELSE 'rejections/pred_' || coalesce(pt.t, chars.char) || '/' || kept.analysis_id || '_' || kept.character_id || '_pred-' || coalesce(pt.t, chars.char) || '_rejected.png' END AS saved_image_path
 FROM kept JOIN chars ON kept.analysis_id = chars.analysis_id AND kept.character_id = chars.character_id JOIN an ON kept.analysis_id = an.analysis_id LEFT JOIN tok pt ON pt.c = chars.char LEFT JOIN tok lt ON lt.c = label)"""


def _request(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, characters, analyses) of feedback requests, some of them faulty."""
    e = D.read(spark, sf_dir, "events")
    k, rejected = F.col("event_id"), F.col("event_type").isin("purchase", "signup")
    number = lambda n: F.concat(F.lit("c"), n.cast("string"))
    item = F.when(k % 97 == 0, " ").when(k % 89 == 0, "c9").when(k % 83 == 0, " c0 ").when(rejected, number(3 + k % 2)).otherwise(number(k % 3))
    said = F.when(rejected, None).when(k % 101 == 0, "=").when(k % 103 == 0, None).otherwise(F.element_at(F.array(*[F.lit(x) for x in ("mul", "7", "(", "slash", "+", "0")]), (k % 6 + 1).cast("int")))
    items = e.select(F.col("user_id").alias("analysis_id"), k.alias("ord"), F.when(rejected, "rejected").otherwise("corrected").alias("action"), item.alias("character_id"), said.alias("corrected_char"))
    users = e.select(F.col("user_id").alias("analysis_id")).distinct()
    u, c = F.col("analysis_id"), F.col("k")
    characters = users.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "analysis_id", number(c).alias("character_id"), D.vocabulary_at((u * 3 + c) % 16).alias("char"), ((u * 7 + c * 13) % 10000 / 10000.0).alias("conf"), D.vocabulary_at((u + c) % 16).alias("raw_char"),
        ((u * 11 + c) % 1000 / 1000.0).alias("raw_conf"), (u % 2 == 0).alias("adjusted"), F.floor(c / 3).cast("int").alias("line_index"), *[((u * m + c) % 100).cast("int").alias(n) for m, n in zip((3, 5, 7, 9), "xywh")])
    return items, characters, users.filter("analysis_id % 7 <> 0").withColumn("source_filename", F.concat(F.lit("scan_"), u.cast("string"), F.lit(".png")))


@query(f"WITH {_ITEMS} SELECT analysis_id, error FROM v")
def feedback_validation(spark, sf_dir):
    return K.validated(*_request(spark, sf_dir))


@query(f"WITH {_SAVED} SELECT analysis_id, source_filename, character_id, predicted_char, corrected_char, confidence, raw_char, action, ord, saved_image_path FROM sv")
def feedback_saved(spark, sf_dir):
    e = K.entries(*_request(spark, sf_dir), F.current_timestamp())
    return e.select("analysis_id", "source_filename", "character_id", "predicted_char", "corrected_char", "confidence", "raw_char", "action", "ord", "saved_image_path")


@query(f"""WITH {_SAVED}, c AS (SELECT analysis_id, count(*) FILTER (action = 'corrected') AS c, count(*) FILTER (action = 'rejected') AS r, string_agg(character_id, ',' ORDER BY ord) FILTER (action = 'corrected') AS cs, string_agg(character_id, ',' ORDER BY ord) FILTER (action = 'rejected') AS rs FROM sv GROUP BY analysis_id)
SELECT analysis_id, coalesce(cs, '') AS corrections, coalesce(rs, '') AS rejections, 'Saved ' || CASE WHEN c > 0 AND r > 0 THEN c || ' correction' || CASE c WHEN 1 THEN '' ELSE 's' END || ' and ' || r || ' rejection' || CASE r WHEN 1 THEN '' ELSE 's' END
 WHEN c > 0 THEN c || ' correction' || CASE c WHEN 1 THEN '' ELSE 's' END ELSE r || ' rejection' || CASE r WHEN 1 THEN '' ELSE 's' END END || '.' AS message FROM c""")
def feedback_reports(spark, sf_dir):
    r = K.reports(K.entries(*_request(spark, sf_dir), F.current_timestamp()))
    return r.select("analysis_id", F.array_join("corrections.character_id", ",").alias("corrections"), F.array_join("rejections.character_id", ",").alias("rejections"), "message")


@query(f"""WITH c AS (SELECT event_id, {_VOCAB}[event_id % 16 + 1] AS char, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE {_VOCAB}[event_id % 15 + 1] END AS corrected, event_id % 13 = 0 AS rejected FROM events)
SELECT event_id, CASE WHEN rejected THEN 'rejected' ELSE 'corrected' END AS pending FROM c WHERE rejected OR (corrected <> '' AND corrected <> char)""")
def pending_feedback(spark, sf_dir):
    k = F.col("event_id")
    rows = D.read(spark, sf_dir, "events").select(k, D.vocabulary_at(k % 16).alias("char"), F.when(k % 3 == 0, None).when(k % 3 == 1, "").otherwise(D.vocabulary_at(k % 15)).alias("corrected_char"), (k % 13 == 0).alias("rejected"))
    return K.pending(rows).select("event_id", "pending")


# --- training rows

_NAMED = f"""WITH {D.SQL['scores']},
e AS (SELECT vec_id, label, logits, list_transform(logits, lambda v: exp(v - list_max(logits))) AS ex FROM scores),
p AS (SELECT vec_id, label, logits, list_reverse_sort(list_transform(ex, lambda v: v / list_sum(ex))) AS s FROM e),
d AS (SELECT vec_id, (['*','/','1','(',')','0','2','3','4','5'])[label + 1] AS truth, {_VOCAB}[list_position(logits, list_max(logits))] AS pred, s[1] AS conf, s[1] - s[2] AS margin FROM p),
h AS (SELECT *, round_even(8 * greatest(0.0::DOUBLE, 0.992::DOUBLE - conf) + 10 * greatest(0.0::DOUBLE, 0.04::DOUBLE - margin) + CASE WHEN pred = truth THEN 0 WHEN (truth = '*' AND pred IN ('+', '4')) OR (truth = '/' AND pred IN ('1', '(', ')')) OR (truth = '1' AND pred IN ('/', '(', ')', '7')) OR (truth IN ('(', ')') AND pred IN ('/', '1')) THEN 1.75 ELSE 1.0 END, 9) AS hardness FROM d),
lim AS (SELECT unnest(['*','/','1','(',')']) AS truth, unnest([10, 20, 15, 10, 10]) AS most, unnest([14, 0, 0, 0, 0]) AS fill),
r AS (SELECT h.*, most, fill, hardness > 0 AND row_number() OVER (PARTITION BY truth ORDER BY hardness DESC, vec_id) <= most AS hard FROM h JOIN lim USING (truth)),
f AS (SELECT *, fill - count(*) FILTER (hard) OVER (PARTITION BY truth) AS missing, row_number() OVER (PARTITION BY truth, hard ORDER BY conf, margin, vec_id) AS least FROM r),
hx AS (SELECT truth, vec_id, hardness, NOT hard AS filled FROM f WHERE hard OR least <= missing)"""
#: Limits that bind on the test tables.
LIMITS, FILL = {"*": 10, "/": 20, "1": 15, "(": 10, ")": 10}, {"*": 14}


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with names of classes; the ten labels stand for ten classes, the five that matter first."""
    p = M.predicted(D.scores(spark, sf_dir))
    return p.withColumns({"truth": F.element_at(F.array(*[F.lit(c) for c in "*/1()02345"]), (F.col("truth") + 1).cast("int")), "pred": D.vocabulary_at(F.col("pred"))})


@query(_NAMED + " SELECT truth, vec_id, round(hardness, 6) AS hardness, filled FROM hx")
def hard_examples(spark, sf_dir):
    return M.hard_examples(_named(spark, sf_dir), LIMITS, FILL).withColumn("hardness", F.round("hardness", 6))


_PARTS = _NAMED + f""", fbk AS (SELECT event_id AS id, {_VOCAB}[CAST(json_extract_string(props, '$.k') AS BIGINT) % 16 + 1] AS label FROM events WHERE event_type NOT IN ('purchase','signup')),
bw AS (SELECT unnest(['*','/','1','(',')']) AS label, unnest([1.6, 1.8, 1.15, 1.1, 1.1])::DOUBLE AS w),
pa AS (SELECT 'base' AS part, vec_id AS id, truth AS label, 1 AS copy, coalesce(w, 1.0) AS weight FROM d LEFT JOIN bw ON truth = label
 UNION ALL SELECT 'target', vec_id, truth, 1, w FROM d JOIN bw ON truth = label WHERE truth = '*'
 UNION ALL SELECT 'feedback', id, label, 1, CASE WHEN label IN ('*','/') THEN 2.5 ELSE 1.25 END FROM fbk
 UNION ALL SELECT 'feedback_more', id, label, unnest(range(1, 25)), 2.5 FROM fbk WHERE label IN ('*','/')
 UNION ALL SELECT 'hard', vec_id, truth, 1, w * 1.2::DOUBLE FROM hx JOIN bw ON truth = label
 UNION ALL SELECT 'hard_more', vec_id, truth, unnest(range(1, CASE WHEN truth IN ('*','/') THEN 3 ELSE 2 END)), w * 1.2::DOUBLE FROM hx JOIN bw ON truth = label)"""


def _training(spark, sf_dir):
    scored = _named(spark, sf_dir)
    as_rows = lambda d: d.select(F.col("vec_id").alias("id"), F.col("truth").alias("label"))
    corrected = D.feedback(spark, sf_dir).filter("action = 'corrected'").select(F.col("event_id").alias("id"), D.vocabulary_at(F.col("label_idx")).alias("label"))
    return M.training_rows(as_rows(scored), corrected, as_rows(M.hard_examples(scored, LIMITS, FILL)))


@query(_PARTS + " SELECT part, label, count(*) AS n, round(sum(weight), 6) AS weight FROM pa GROUP BY ALL")
def training_union(spark, sf_dir):
    return _training(spark, sf_dir).groupBy("part", "label").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("weight"))


@query(_PARTS + " SELECT part, id, copy, round(weight, 6) AS weight, row_number() OVER (ORDER BY md5('42:' || part || ':' || id || ':' || copy)) - 1 AS place FROM pa")
def training_order(spark, sf_dir):
    return _training(spark, sf_dir).select("part", "id", "copy", F.round("weight", 6).alias("weight"), "place")


@query("WITH r AS (SELECT p_partkey AS id, 'digits' AS source FROM part UNION ALL SELECT s_suppkey, 'letters' FROM supplier UNION ALL SELECT c_custkey, 'operators' FROM customer), o AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || source || ':' || id)) - 1 AS place FROM r) SELECT id, source, place, CASE WHEN place < floor((SELECT count(*) FROM r) * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM o")
def dataset_split(spark, sf_dir):
    """Three sources of pictures in one seeded order; the first tenth is for validation."""
    of = lambda table, key, name: D.read(spark, sf_dir, table).select(F.col(key).alias("id"), F.lit(name).alias("source"))
    return M.split_rows(of("part", "p_partkey", "digits").unionByName(of("supplier", "s_suppkey", "letters")).unionByName(of("customer", "c_custkey", "operators")), ["source", "id"])


@query("""WITH o AS (SELECT o_orderkey, (o_orderkey*101%1000/1000.0)::DOUBLE AS pr, (o_orderkey*37%100/1000.0)::DOUBLE AS ac, lag((o_orderkey*101%1000/1000.0)::DOUBLE) OVER w AS bp, lag((o_orderkey*37%100/1000.0)::DOUBLE) OVER w AS ba FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey, pr > bp + 1e-6 AND ac >= ba - 0.0025 AS promoted FROM o WHERE bp IS NOT NULL""")
def promotion(spark, sf_dir):
    k, w = F.col("o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = D.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (k * 101 % 1000 / 1000.0).alias("p"), (k * 37 % 100 / 1000.0).alias("a"))
    base = rows.withColumns({"bp": F.lag("p").over(w), "ba": F.lag("a").over(w)}).filter("bp is not null")
    return base.select("o_orderkey", M.promotes(F.col("bp"), F.col("ba"), F.col("p"), F.col("a")).alias("promoted"))


@query(f"WITH {D.SQL['scores']} SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label ELSE list_position(logits, list_max(logits)) - 1 END AS label FROM scores")
def label_vectors(spark, sf_dir):
    """Rows of one label or of scores as labels."""
    s = D.scores(spark, sf_dir)
    return s.select("vec_id", M.label_vector(F.when(F.col("vec_id") % 3 == 0, F.array(F.col("label").cast("double"))).otherwise(F.col("logits"))).alias("label"))


@query(f"WITH {D.SQL['binary_eval']} SELECT truth AS label FROM binary_eval UNION SELECT pred FROM binary_eval")
def label_union(spark, sf_dir):
    return M.labels_of(D.binary_eval(spark, sf_dir))


# --- reports and replays

@query(f"""WITH {D.SQL['glyphs']}, {D.SQL['exprs']}, c AS (SELECT o_orderkey AS image_id, raw FROM exprs), g AS (SELECT image_id, count(*)::INT AS n, avg(w) AS mw, avg(h) AS mh FROM glyphs GROUP BY image_id)
SELECT c.image_id, length(raw)::INT AS true_length, coalesce(n, 0) AS pred_length, coalesce(n, 0) - length(raw)::INT AS length_diff,
 CASE WHEN coalesce(n, 0) = length(raw) THEN 'OK_length' WHEN coalesce(n, 0) < length(raw) THEN 'UNDER_SEGMENT' ELSE 'OVER_SEGMENT' END AS status,
 CASE WHEN coalesce(n, 0) < length(raw) THEN 'Missing characters (characters touching or strokes lost)' WHEN n > length(raw) THEN 'Extra characters (noise, broken box, or over-splitting)' END AS issue,
 round(coalesce(mw, 0), 6) AS mean_rect_width, round(coalesce(mh, 0), 6) AS mean_rect_height FROM c LEFT JOIN g USING (image_id)""")
def segmentation_report(spark, sf_dir):
    cases = D.expressions(spark, sf_dir).select(F.col("o_orderkey").alias("image_id"), F.col("raw").alias("true_expr"))
    r = E.segmentation_report(D.glyphs(spark, sf_dir), cases)
    return r.withColumns({c: F.round(c, 6) for c in ("mean_rect_width", "mean_rect_height")})


_PLACES = f"""WITH {D.SQL['glyphs']}, s AS (SELECT image_id, char, row_number() OVER (PARTITION BY image_id ORDER BY glyph_id) AS place FROM glyphs),
x AS (SELECT image_id, {_VOCAB}[(place * 5 + image_id) % 16 + 1] AS expected, place FROM s WHERE place <= 4)"""


def _places(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("glyph_id"))
    said = D.glyphs(spark, sf_dir).select("image_id", "char", place.alias("place"))
    return said, said.filter("place <= 4").select("image_id", D.vocabulary_at((F.col("place") * 5 + F.col("image_id")) % 16).alias("expected"), "place")


@query(_PLACES + " SELECT s.image_id, s.place, char, expected FROM s JOIN x ON s.image_id = x.image_id AND s.place = x.place")
def positional_zip(spark, sf_dir):
    return E.zipped(*_places(spark, sf_dir)).select("image_id", "place", "char", "expected")


@query(_PLACES + " SELECT count(*) AS n, count(*) FILTER (char = expected) AS n_correct, round(count(*) FILTER (char = expected) * 100.0::DOUBLE / count(*), 6) AS accuracy FROM s LEFT JOIN x ON s.image_id = x.image_id AND s.place = x.place")
def place_accuracy(spark, sf_dir):
    return E.by_place(*_places(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


_CASES = f"""WITH {D.SQL['exprs']},
c AS (SELECT o_orderkey AS analysis_id, '(' || a || '+' || b || ')*' || c AS expected_expression, ((a + b) * c)::VARCHAR AS expected_result, CASE template % 5 WHEN 0 THEN '(' || a || '+' || b || ')*' || c WHEN 1 THEN '(' || a || '+' || b || ')' || c WHEN 2 THEN (a + b) * c || '' WHEN 3 THEN a || '+' || b ELSE a || '+' END AS reading,
 CASE template % 5 WHEN 0 THEN (a + b) * c WHEN 1 THEN NULL WHEN 2 THEN (a + b) * c WHEN 3 THEN a + b END::VARCHAR AS value, o_orderkey % 9 = 0 AS several, template % 5 AS form, a, b, c FROM exprs),
r AS (SELECT analysis_id, expected_expression, expected_result, CASE WHEN several THEN 'Detected multiple lines' WHEN form = 1 THEN '(' || a || '+' || b || ')*' || c ELSE reading END AS pred_expr,
 CASE WHEN NOT several THEN CASE WHEN form = 1 THEN ((a + b) * c)::VARCHAR ELSE value END END AS pred_result,
 CASE WHEN several THEN 'Expected a single expression line.' WHEN form = 4 THEN 'Validation failed: Expression cannot end with ''+''.' END AS pred_error FROM c),
m AS (SELECT *, coalesce(pred_expr = expected_expression, false) AS expr_match, coalesce(pred_result = expected_result, false) AS result_match FROM r)"""


def _replayed(spark, sf_dir):
    e = D.expressions(spark, sf_dir)
    text = lambda *parts: F.concat(*[F.lit(p) if p in "()+*" else F.col(p).cast("string") for p in parts])
    whole = text("(", "a", "+", "b", ")", "*", "c")
    forms = F.array(whole, text("(", "a", "+", "b", ")", "c"), ((F.col("a") + F.col("b")) * F.col("c")).cast("string"), text("a", "+", "b"), text("a", "+"))
    key = F.col("o_orderkey").alias("analysis_id")
    cases = e.select(key, whole.alias("expected_expression"))
    records = e.select(key, F.split(F.element_at(forms, F.col("template") % 5 + 1), "").alias("tokens"), F.when(F.col("o_orderkey") % 9 == 0, 2).otherwise(1).alias("n_lines"))
    return E.replayed(cases, records)


@query(_CASES + " SELECT * FROM m")
def replayed_cases(spark, sf_dir):
    return _replayed(spark, sf_dir).select("analysis_id", "expected_expression", "expected_result", "pred_expr", "pred_result", "pred_error", "expr_match", "result_match")


@query(_CASES + " SELECT count(*) AS total_cases, count(*) FILTER (expr_match) AS expression_correct, count(*) FILTER (result_match) AS result_correct, round(avg(expr_match::INT), 6) AS expression_accuracy, round(avg(result_match::INT), 6) AS result_accuracy FROM m")
def replay_totals(spark, sf_dir):
    return E.case_totals(_replayed(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("expression_accuracy", "result_accuracy")})


@query(f"""WITH {D.SQL['exprs']}, o AS (SELECT o_orderkey, raw, (length(raw) - length(replace(raw, '(', '')) <> length(raw) - length(replace(raw, ')', ''))) AS open FROM exprs)
SELECT o_orderkey, CASE WHEN regexp_full_match(raw, '\\+.*') THEN 'invalid: Validation failed: Expression cannot start with ''+''.' WHEN regexp_full_match(raw, '.*\\*') THEN 'invalid: Validation failed: Expression cannot end with ''*''.'
 WHEN contains(raw, '+-') THEN 'invalid: Validation failed: Two consecutive operators ''+'' and ''-'' at position ' || strpos(raw, '+-') || '.' WHEN open THEN 'invalid: Validation failed: Unmatched ''('' - parentheses are not balanced.'
 WHEN regexp_full_match(raw, '[0-9]+/0') THEN 'invalid: Division by zero is not allowed.' WHEN contains(raw, '++') THEN 'normalized to ' || replace(raw, '++', '+') WHEN regexp_matches(raw, '[0-9]\\(') THEN 'normalized to ' || regexp_replace(raw, '([0-9])\\(', '\\1*(') END AS unfit FROM o""")
def expected_results(spark, sf_dir):
    """Which expressions may serve as expected ones: valid, and written as they are read."""
    return E.expected_results(D.expressions(spark, sf_dir).withColumn("expected_expression", F.col("raw"))).select("o_orderkey", "unfit")


@query(f"""WITH {D.SQL['exprs']}, i AS (SELECT DISTINCT o_custkey AS image_id FROM orders UNION SELECT c_custkey FROM customer), l AS (SELECT o_orderkey // 3 AS image_id, raw FROM exprs WHERE template IN (0, 5) AND (o_orderkey // 3) IN (SELECT image_id FROM i)),
g AS (SELECT image_id, count(*) AS n, count(*) FILTER (raw LIKE '(%') AS ok, min(raw) AS raw, min(eval) AS v FROM (SELECT l.*, CASE WHEN raw LIKE '(%' THEN (regexp_extract(raw, '\\((\\d+)\\+(\\d+)\\)\\*(\\d+)', 1)::BIGINT + regexp_extract(raw, '\\((\\d+)\\+(\\d+)\\)\\*(\\d+)', 2)::BIGINT) * regexp_extract(raw, '\\((\\d+)\\+(\\d+)\\)\\*(\\d+)', 3)::BIGINT END AS eval FROM l) GROUP BY image_id)
SELECT i.image_id, CASE WHEN n IS NULL THEN '' WHEN n = 1 THEN raw ELSE 'Detected ' || n || ' lines' END AS expression, CASE WHEN n = 1 THEN v::VARCHAR WHEN n > 1 THEN ok || '/' || n || ' lines evaluated successfully' END AS result,
 CASE WHEN n IS NULL THEN 'No valid expression lines were produced.' WHEN n = 1 AND ok = 0 THEN 'Validation failed: Expression cannot end with ''*''.' END AS error FROM i LEFT JOIN g USING (image_id)""")
def evaluated_images(spark, sf_dir):
    """Every image's reading, also of those without lines."""
    images = D.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("image_id")).union(D.read(spark, sf_dir, "customer").select("c_custkey")).distinct()
    lines = D.expressions(spark, sf_dir).filter("template in (0, 5)").select(F.floor(F.col("o_orderkey") / 3).alias("image_id"), F.split("raw", "").alias("tokens"))
    return E.read_lines(lines, images)
