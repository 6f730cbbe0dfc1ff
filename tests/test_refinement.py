"""Refinement of glyph lines: given lines and overrides, and random lines against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from inkframe.operators import refinement as R

NEUTRAL = {"aspect": 0.9, "fill": 0.4, "left": 0.4, "right": 0.4, "top": 0.4, "bottom": 0.4, "center": 0.5, "center_row": 0.4, "center_col": 0.4, "diag_primary": 0.5, "diag_secondary": 0.5, "holes": 1.0, "content_w": 20.0, "content_h": 24.0}
#: Measures of drawn shapes; digits look like nothing in particular.
SHAPES = {
    "(": {"holes": 0, "aspect": 0.4, "left": 0.6, "right": 0.3, "center": 0.4, "center_row": 0.5, "center_col": 0.5}, ")": {"holes": 0, "aspect": 0.4, "left": 0.3, "right": 0.6, "center": 0.4, "center_row": 0.5, "center_col": 0.5},
    "/": {"holes": 0, "aspect": 0.8, "fill": 0.3, "left": 0.3, "right": 0.3, "center_row": 0.25, "center_col": 0.3, "diag_primary": 0.1, "diag_secondary": 1.0}, "-": {"holes": 0, "aspect": 4.0, "content_h": 5.0, "center_row": 0.9},
    "*": {"holes": 0, "aspect": 1.0, "fill": 0.5, "center": 0.8, "diag_primary": 1.2, "diag_secondary": 1.25}, "1": {"holes": 0, "aspect": 0.4, "center": 0.6, "center_col": 0.6, "content_w": 8.0}, "7": {"holes": 0, "aspect": 0.6, "fill": 0.25, "center": 0.3, "center_col": 0.3},
}
ROW = "image_id long, place int, x int, y int, w int, h int, char string, conf double, raw_char string, raw_conf double, top_k array<struct<char:string,conf:double>>, " + ", ".join(f"`{m}` double" for m in R.MEASURES)


def rows_of(image, shapes, wrong, y=0):
    out = []
    for k, shape in enumerate(shapes):
        pred = wrong.get(k, shape)
        conf = 0.99 if pred == shape else 0.56
        top = [(pred, conf)] + ([(shape, 0.41)] if pred != shape else [])
        f = {m: float(v) for m, v in (NEUTRAL | SHAPES.get(shape, {})).items()}
        out.append((image, k, 36 * k, y, 28, 28, pred, conf, pred, conf, top, *[f[m] for m in R.MEASURES]))
    return out


def items(spark, rows):
    df = spark.createDataFrame(rows, ROW)
    return df.select("image_id", R.glyph({c: F.col(c) for c in df.columns}).alias("item"))


def lines(spark, rows):
    none = F.array().cast(f"array<struct<left:int,right:int,f:struct<{','.join(f'{m}:double' for m in R.MEASURES)}>>>")
    return items(spark, rows).groupBy("image_id").agg(F.array_sort(F.collect_list("item")).alias("items")).withColumn("together", none)


GOLDEN = [
    ("(1*7)*3+5/6", {0: "/", 1: "/", 4: "/", 9: "("}),
    ("7/3+(5-6+2)*2", {1: ")", 4: "1", 10: "1"}),
    ("(5+3-2)*8/3", {0: "1", 6: "/", 9: ")"}),
    ("4+5-6/7*3+(5-4)", {5: "(", 10: "1", 14: "/"}),
]


def test_lines_with_wrong_classes_come_out_as_drawn(spark):
    rows = [r for k, (text, wrong) in enumerate(GOLDEN) for r in rows_of(k, text, wrong)]
    got = {r.image_id: "".join(g["char"] for g in r["items"]) for r in R.refine(lines(spark, rows)).collect()}
    assert got == {k: text for k, (text, _) in enumerate(GOLDEN)}
    by_image = R.refine_images(items(spark, rows)).collect()
    # of images, two unsure operators in a row are corrected first, which makes the 1 of the first line a 7
    assert {r.image_id: "".join(g["char"] for g in r["items"]) for r in by_image} == got | {0: "(7*7)*3+5/6"} and {r.line for r in by_image} == {0}


def test_single_overrides(spark):
    cases = [("1", "/", None, "5", "1"), ("(", "/", None, "6", "("), ("/", "(", "5", "6", "/"), ("/", "1", "8", "3", "/"), ("*", "+", "1", "7", "*"), (")", "1", "4", None, ")"), ("1", "8", "3", "3", "8")]
    rows = [rows_of(k, shape, {0: pred})[0] for k, (shape, pred, *_) in enumerate(cases)]
    own = items(spark, rows).join(spark.createDataFrame([(k, b, a) for k, (_, _, b, a, _) in enumerate(cases)], "image_id long, b string, a string"), "image_id")
    got = {r.image_id: r.c for r in own.select("image_id", R.expression_char(F.col("item"), F.col("b"), F.col("a")).alias("c")).collect()}
    assert [got[k] for k in range(len(cases))] == [c[4] for c in cases]
    minus = items(spark, [rows_of(0, "-", {})[0]]).select(F.col("item").withField("w", F.lit(16)).withField("h", F.lit(4)).withField("conf", F.lit(0.999)).cast(R.ITEM).alias("g"))
    assert minus.select(R.is_noise(F.col("g"), F.lit(1200.0), F.lit(45.0)).alias("n")).first().n is False


def random_rows(rng, n_images):
    """Lines of random shapes and sizes, some of them numbers, with strokes close to one another."""
    out = []
    for image in range(n_images):
        x, number = 0, image % 3 == 0
        for k in range(rng.randint(1, 11)):
            shape = rng.choice("0123456789" if number and rng.random() < 0.93 else "0123456789+-*/()")
            pred = rng.choice("17/()-4+*") if rng.random() < 0.25 and not number else shape
            w, h = rng.choice([6, 12, 28, 40]), rng.choice([8, 28, 40, 60])
            f = NEUTRAL | (SHAPES.get(rng.choice("(/1*-)"), {}) if rng.random() < 0.3 else SHAPES.get(shape, {}))
            top = [(pred, round(rng.uniform(0.2, 1), 2)), (rng.choice("/1(*"), round(rng.uniform(0, 0.6), 2))] if rng.random() < 0.8 else []
            out.append((image, k, x, rng.choice([0, 5, 30, 200 if image % 7 == 0 else 9]), w, h, pred, round(rng.uniform(0.4, 1), 3), pred, 0.5, top, *[float(f[m]) for m in R.MEASURES]))
            x += max(1, w + rng.choice([-8, -2, 1, 3, 20, 60]))
    return out


def med(values):
    s = sorted(values)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


def plain_clusters(row, tol):
    groups = []
    for g in sorted(row, key=lambda g: (g["y"] + g["h"] / 2, g["place"])):
        cy = g["y"] + g["h"] / 2
        for own in groups:
            if abs(cy - sum(m["y"] + m["h"] / 2 for m in own) / len(own)) <= tol:
                own.append(g)
                break
        else:
            groups.append([g])
    return groups


def plain_numeric(row):
    return len(row) >= 5 and not any(g["strong"] for g in row) and sum(g["char"] in "0123456789()/" for g in row) >= len(row) - 1


@pytest.fixture(scope="module")
def random_lines(spark):
    rows = random_rows(random.Random(3), 160)
    flat = items(spark, rows).select("image_id", F.col("item").alias("g"), R.strong_operator(F.col("item")).alias("strong"), F.col("item.s.minus").alias("minus"), F.col("item.s.slash").alias("slash"))
    plain = {}
    for r in flat.collect():
        plain.setdefault(r.image_id, []).append(r.g.asDict() | {"strong": r.strong, "minus": r.minus, "slash": r.slash})
    return lines(spark, rows).persist(), {k: sorted(v, key=lambda g: g["place"]) for k, v in plain.items()}


def places(df, column):
    return {r[0]: [g["place"] for g in r[1]] for r in df.select("image_id", column.alias("c")).collect()}


def test_rows_of_a_line(random_lines):
    df, plain = random_lines
    want, several = {}, 0
    for k, row in plain.items():
        ma, mh = med([g["w"] * g["h"] for g in row]), med([g["h"] for g in row])
        core = [g for g in row if g["w"] * g["h"] >= max(150, ma * 0.2)]
        cy = [g["y"] + g["h"] / 2 for g in core]
        kept = row
        if len(core) >= 3 and max(cy) - min(cy) > max(120, mh * 1.65):
            groups = [g for g in plain_clusters(core, max(28, mh * 0.65)) if len(g) >= 3]
            if len(groups) > 1:
                best = max(groups, key=lambda t: len(t) * 1000 + sum(g["w"] * g["h"] for g in t) - min(g["y"] + g["h"] / 2 for g in t))
                c = sum(g["y"] + g["h"] / 2 for g in best) / len(best)
                kept = [g for g in row if abs(g["y"] + g["h"] / 2 - c) <= max(40, mh * 0.85)] or row
                several += 1
        want[k] = [g["place"] for g in sorted(kept, key=lambda g: (g["x"], g["place"]))]
    assert places(df, R.main_line(F.col("items"))) == want and several >= 0
    groups = df.select("image_id", R.first_fit(F.col("items"), F.lit(28.0)).alias("c")).collect()
    assert {r.image_id: [sorted(g["place"] for g in t["items"]) for t in r.c] for r in groups} == {k: [sorted(g["place"] for g in t) for t in plain_clusters(row, 28.0)] for k, row in plain.items()}


def test_noise_at_the_ends_of_numbers(random_lines):
    df, plain = random_lines
    want, cut = {}, 0
    for k, row in plain.items():
        rest = list(row)
        if len(row) >= 6:
            ma, mh = med([g["w"] * g["h"] for g in row]), med([g["h"] for g in row])
            frag = lambda g: g["w"] * g["h"] <= max(180, ma * 0.32) and g["h"] <= max(32, mh * 0.46) and (g["char"] in "+-*/()" or g["minus"] or g["slash"])  # noqa: E731, B023
            while len(rest) >= 6:
                if frag(rest[0]) and plain_numeric(rest[1:]):
                    rest = rest[1:]
                elif frag(rest[-1]) and plain_numeric(rest[:-1]):
                    rest = rest[:-1]
                else:
                    break
        cut += len(rest) < len(row)
        want[k] = [g["place"] for g in rest]
    assert places(df, R.without_edge_noise(F.col("items"))) == want and cut > 0
    assert {r.image_id: r.c for r in df.select("image_id", R.is_numeric(F.col("items")).alias("c")).collect()} == {k: plain_numeric(row) for k, row in plain.items()}


def test_pairs_are_passed_over(random_lines):
    """Merging by any test: here neighbours closer than two pixels."""
    df, plain = random_lines
    close = lambda a, b, before, after: F.when(b["x"] - (a["x"] + a["w"]) <= 2, R._joined(a, b, F.concat(F.coalesce(before, F.lit("^")), F.coalesce(after, F.lit("$")))))
    want = {}
    for k, row in plain.items():
        out, i = [], 0
        while i < len(row):
            if i + 1 < len(row) and row[i + 1]["x"] - row[i]["x"] - row[i]["w"] <= 2:
                out.append((row[i]["place"], (row[i - 1]["char"] if i else "^") + (row[i + 2]["char"] if i + 2 < len(row) else "$")))
                i += 2
            else:
                out.append((row[i]["place"], row[i]["char"]))
                i += 1
        want[k] = out
    got = {r.image_id: [(g["place"], g["char"]) for g in r.c] for r in df.select("image_id", R.folded_pairs(F.col("items"), close).alias("c")).collect()}
    assert got == want and sum(len(v) < len(plain[k]) for k, v in want.items()) > 30


def test_overrides_see_what_was_decided_before(random_lines):
    df, plain = random_lines
    got = {r.image_id: "".join(g["char"] for g in r.c) for r in df.select("image_id", R.overridden(F.col("items")).alias("c")).collect()}
    now = {k: [] for k in plain}
    for at in range(11):  # a glyph of every line at a time
        todo = [(k, at, now[k][-1] if at else None, row[at + 1]["char"] if at + 1 < len(row) else None) for k, row in plain.items() if at < len(row)]
        if not todo:
            break
        ask = df.sparkSession.createDataFrame(todo, "image_id long, at int, b string, a string")
        for r in df.join(ask, "image_id").select("image_id", R.expression_char(F.col("items")[F.col("at")], F.col("b"), F.col("a")).alias("c")).collect():
            now[r.image_id].append(r.c)
    assert got == {k: "".join(v) for k, v in now.items()}
    assert sum("".join(g["char"] for g in row) != got[k] for k, row in plain.items()) > 10


def test_stray_minuses_at_the_ends(random_lines):
    df, plain = random_lines
    want = {}
    for k, row in plain.items():
        ma, mh = 900.0, 30.0
        stray = lambda g, gap: g["char"] in "+-*/" and g["minus"] and g["w"] * g["h"] < max(45, ma * 0.25) and gap > mh * 0.45  # noqa: E731, B023
        rest = list(row)
        while len(rest) >= 2 and stray(rest[0], rest[1]["x"] - rest[0]["x"] - rest[0]["w"]):
            rest = rest[1:]
        while len(rest) >= 2 and stray(rest[-1], rest[-1]["x"] - rest[-2]["x"] - rest[-2]["w"]):
            rest = rest[:-1]
        want[k] = [g["place"] for g in rest]
    assert places(df, R.without_edge_operators(F.col("items"), F.lit(900.0), F.lit(30.0))) == want


def test_best_expression_against_all_readings():
    """Every choice of one option a place: the best whole expression wins unless the given one is nearly as good."""
    import itertools

    from inkframe.operators.context import bonus, step

    rng, changed = random.Random(5), 0
    for _ in range(300):
        n = rng.randint(2, 5)
        chars, conf = [rng.choice("12+-*/()") for _ in range(n)], [round(rng.uniform(0.3, 1), 2) for _ in range(n)]
        options = [[(c, p + 0.55), *[(rng.choice("17/()*-"), round(rng.uniform(0.7, 1.02), 2)) for _ in range(rng.randint(0, 2))]] for c, p in zip(chars, conf)]

        def score(text, points):
            state, total, last = (0, True), 0.0, ""
            for c, p in zip(text, points):
                state = step(state, c)
                if state is None:
                    return None
                total, last = total + p + bonus(last, c), c
            return total if state == (0, False) else None

        best = max((s for pick in itertools.product(*options) if (s := score([c for c, _ in pick], [p for _, p in pick])) is not None), default=None)
        own = score(chars, [p + 0.55 for p in conf])
        got = R.best_expression(chars, conf, options)
        if best is None or own is not None and best < own + 0.20:
            assert got == chars
        else:
            most = [max(p for c, p in place if c == g) for place, g in zip(options, got)]
            assert score(got, most) == pytest.approx(best)
            changed += got != chars
    assert changed > 30


def test_halves_of_a_digit(spark):
    rows = rows_of(0, "1234567", {})
    close = [r[:2] + (40 * k - (26 if k == 3 else 0),) + r[3:4] + (14 if k in (2, 3) else 28, 28) + r[6:] for k, r in enumerate(rows)]
    df = lines(spark, close)
    both = {m: 0.4 for m in R.MEASURES} | {"holes": 1.0, "right": 0.6, "center": 0.3}
    f = F.struct(*[F.lit(float(both[m])).alias(m) for m in R.MEASURES])
    df = df.withColumn("together", F.array(F.struct(F.lit(2).alias("left"), F.lit(3).alias("right"), f.alias("f"))))
    got = df.select(R.merged_halves(F.col("items"), F.col("together"), F.lit(28.0)).alias("c")).first().c
    assert "".join(g["char"] for g in got) == "129567" and got[2]["raw_char"] == "34" and got[2]["adjusted"]


def test_stored_glyphs_are_refined_before_they_are_compared(spark):
    from inkframe.operators import evaluation as E

    rows = [r for k, (text, wrong) in enumerate(GOLDEN) for r in rows_of(k, text, wrong)]
    rows += rows_of(7, "1+2", {}) + rows_of(7, "3+4", {}, y=400)
    glyphs = items(spark, rows).withColumnRenamed("image_id", "analysis_id")
    cases = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(GOLDEN)] + [(7, "1+2")], "analysis_id long, expected_expression string")
    got = {r.analysis_id: r for r in E.replayed_glyphs(cases, glyphs).collect()}
    assert {k: r.expr_match for k, r in got.items()} == {0: False, 1: True, 2: True, 3: True, 7: False} and got[1].result_match
    assert got[0].pred_expr == "(7*7)*3+5/6" and (got[7].pred_expr, got[7].pred_result, got[7].pred_error) == ("Detected multiple lines", None, "Expected a single expression line.")
    with pytest.raises(Exception, match="Missing analysis record"):
        E.replayed_glyphs(spark.createDataFrame([(99, "1+2")], "analysis_id long, expected_expression string"), glyphs).collect()
