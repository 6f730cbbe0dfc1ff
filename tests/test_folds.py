"""Folds and greedy matches against plain Python, on whole tables."""

import os

import pytest
from pyspark.sql import functions as F

from inkframe.operators import boxes as B
from inkframe.operators import context as C
from inkframe.operators import pixels as P
from inkframe.plans import catalog, vision
from inkframe.sources import derived as D
from inkframe.sources import files

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def med(values):
    s = sorted(values)
    return (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


def by_image(df, *columns):
    out = {}
    for r in df.collect():
        out.setdefault(r.image_id, []).append(tuple(r[c] for c in columns))
    return out


def broken(a, b, mh, mw):
    (x1, y1, w1, h1), (x2, y2, w2, h2) = a, b
    dx, dy = abs(x1 + w1 / 2 - x2 - w2 / 2), abs(y1 + h1 / 2 - y2 - h2 / 2)
    gx, gy = max(0, max(x1, x2) - min(x1 + w1, x2 + w2)), max(0, max(y1, y2) - min(y1 + h1, y2 + h2))
    ox, oy = max(0, min(x1 + w1, x2 + w2) - max(x1, x2)), max(0, min(y1 + h1, y2 + h2) - max(y1, y2))
    cw, ch = max(x1 + w1, x2 + w2) - min(x1, x2), max(y1 + h1, y2 + h2) - min(y1, y2)
    lw, lh = min(w1, w2), min(h1, h2)
    if cw > max(w1, w2, mw) * 1.3:
        return False
    if ox / max(1, lw) >= 0.4 and dx <= max(10, lw * 0.45, mw * 0.35) and dy >= max(6, lh * 0.22) and gy <= max(18, mh * 0.35) and ch <= max(mh * 1.8, max(h1, h2) * 2.2):
        return True
    if lw >= mw * 0.5 and gx <= max(10, mw * 0.18) and dy <= max(10, mh * 0.22) and oy >= lh * 0.45:
        return False
    return (gy <= max(12, mh * 0.18) and dy >= max(8, lh * 0.2) and ox >= lw * 0.2 and dx <= max(10, mw * 0.45, lw * 0.6)) or (oy > lh * 0.4 and gx <= max(4, lw * 0.12) and cw <= max(w1, w2) * 1.6) or (min(lw, lh) <= 14 and gx <= 12 and gy <= 12)


def test_merge_broken(spark):
    for table in (D.glyphs(spark, DATA), vision._fragments(spark, DATA)):
        want, merged = [], 0
        for image, rows in by_image(table, "x", "glyph_id", "y", "w", "h").items():
            mh, mw = med([r[4] for r in rows]), med([r[3] for r in rows])
            rects = [(x, y, w, h) for x, _, y, w, h in sorted(rows)]
            used = set()
            for i, box in enumerate(rects):
                if i in used:
                    continue
                used.add(i)
                n, again = 1, True
                while again:
                    again = False
                    for j, o in enumerate(rects):
                        if j not in used and broken(box, o, mh, mw):
                            x, y = min(box[0], o[0]), min(box[1], o[1])
                            box = (x, y, max(box[0] + box[2], o[0] + o[2]) - x, max(box[1] + box[3], o[1] + o[3]) - y)
                            used.add(j)
                            n, again = n + 1, True
                            break
                want.append((image, *box, n))
                merged += n > 1
        assert sorted(tuple(r) for r in B.merge_broken(table).collect()) == sorted(want) and merged > 20


def test_pairs_merge_pass_by_pass(spark):
    """Each pass is held against SQL (merge_pairs_once); here four of them, each from the one before."""
    now = vision._fragments(spark, DATA)
    for _ in range(4):
        flags = B.neighbours(now, vision._pair_ink).withColumn("fits", F.expr(" or ".join(B.PAIR_RULES)))
        rows, n_images = by_image(flags, "x", "glyph_id", "y", "w", "h", "fits"), 0
        out = []
        for image, own in rows.items():
            own.sort()
            i = 0
            while i < len(own):
                x, g, y, w, h, fits = own[i]
                if fits and i + 1 < len(own):
                    x2, g2, y2, w2, h2, _ = own[i + 1]
                    left, top = min(x, x2), min(y, y2)
                    out.append((image, min(g, g2), left, top, max(x + w, x2 + w2) - left, max(y + h, y2 + h2) - top))
                    i += 2
                    n_images += 1
                else:
                    out.append((image, g, x, y, w, h))
                    i += 1
        now = spark.createDataFrame(out, "image_id long, glyph_id long, x long, y long, w long, h long")
    got = sorted(tuple(r) for r in catalog.QUERIES["merge_pairs"](spark, DATA).select(*now.columns).collect())
    # images of two to four boxes have fewer passes
    small = {i for i, r in by_image(vision._fragments(spark, DATA), "glyph_id").items() if len(r) < 5}
    assert [r for r in got if r[0] not in small] == [r for r in sorted(out) if r[0] not in small]


def test_boxes_added_one_after_the_other(spark):
    f = by_image(vision._fragments(spark, DATA), "x", "glyph_id", "y", "w", "h")
    want = []
    for image, rows in f.items():
        kept = sorted(r for r in rows if r[1] % 3)
        for r in sorted(r for r in rows if not r[1] % 3):
            over = lambda k: max(0, min(r[0] + r[3], k[0] + k[3]) - max(r[0], k[0])) * max(0, min(r[2] + r[4], k[2] + k[4]) - max(r[2], k[2])) / min(r[3] * r[4], k[3] * k[4])  # noqa: E731, B023
            if not any(over(k) >= 0.72 for k in kept):
                kept.append(r)
        want += [(image, g, x, y, w, h) for x, g, y, w, h in kept]
    assert sorted(tuple(r) for r in catalog.QUERIES["boxes_added"](spark, DATA).collect()) == sorted(want)


def test_lines_by_first_fit(spark):
    want = []
    for image, rows in by_image(D.glyphs(spark, DATA), "y", "h", "glyph_id").items():
        near, lines = max(28.0, med([h for _, h, _ in rows]) * 0.65), []
        for c, g in sorted((y + h / 2, g) for y, h, g in rows):
            for k, own in enumerate(lines):
                if abs(c - sum(own) / len(own)) <= near:
                    own.append(c)
                    break
            else:
                k = len(lines)
                lines.append([c])
            want.append((image, g, k))
    assert sorted(tuple(r) for r in catalog.QUERIES["line_clusters"](spark, DATA).collect()) == sorted(want)


def test_sequences_in_context(spark):
    ops, flips = "+-*/", {"-": "1", "/": "7", "+": "4"}
    want = {}
    for image, rows in by_image(catalog._sequence(spark, DATA), "place", "char", "conf").items():
        rows.sort()
        c, p = [r[1] for r in rows], [r[2] for r in rows]
        before = "".join(c)

        def flip(i):
            if p[i] < 0.82 and c[i] in flips:
                c[i], p[i] = flips[c[i]], p[i] * 0.95

        if c[0] in ops:
            flip(0)
        for i in range(1, len(c)):
            if c[i - 1] in ops and c[i] in ops:
                flip(i - (p[i - 1] < p[i]))
        if c[-1] in ops:
            flip(len(c) - 1)
        for i in range(1, len(c)):
            if c[i - 1] in ops and c[i] in ops:
                flip(i)
        want[image] = (before, "".join(c))
    assert {r.image_id: (r.before, r.after) for r in catalog.QUERIES["correct_sequence"](spark, DATA).collect()} == want
    assert sum(a != b for a, b in want.values()) > 20


def test_best_readings(spark):
    """All states kept, no beam: the best whole expression of two options a place, else the places' first options."""
    other = dict(zip("0123456789+-*/()", "94-()/7*+1653928"))
    got = {r.image_id: r.reading for r in catalog.QUERIES["beam_select"](spark, DATA).collect()}
    whole = 0
    for image, rows in by_image(catalog._sequence(spark, DATA), "place", "char", "conf").items():
        states = {(0, True, ""): (0.0, "")}
        first = ""
        for _, char, conf in sorted(rows):
            options, grown = [(char, conf), (other[char], conf * 0.9)], {}
            first += min(((-p, c) for c, p in options))[1]
            for (depth, term, last), (total, text) in states.items():
                for c, p in options:
                    if (s := C.step((depth, term), c)) is not None:
                        v = total + p + C.bonus(last, c)
                        if (*s, c) not in grown or v > grown[(*s, c)][0] + 1e-12:
                            grown[(*s, c)] = (v, text + c)
            states = grown
        good = [v for (d, t, _), v in states.items() if d == 0 and not t]
        if not good:
            assert got[image] == first
        else:
            whole += 1
            best = max(good)[0]
            assert any(abs(v - best) < 1e-9 and t == got[image] for v, t in good)
    assert whole > 20


def test_even_and_deep_cuts(spark):
    """Pieces lie side by side, and pages are cut into as many as asked where the valleys are deep enough."""
    rows = catalog.QUERIES["split_wide_boxes"](spark, DATA).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault((r.glyph_id, r.how), []).append((r.x, r.w))
    for (page, how), own in pieces.items():
        own.sort()
        assert all(x + w <= x2 for (x, w), (x2, _) in zip(own, own[1:])) and 2 <= len(own) <= page % 9 + 1
    solid = spark.range(420).selectExpr("1L as glyph_id", "id div 42 as y", "id % 42 as x", "1 as v")
    cut = P.split_wide(solid, F.col("v") == 1, spark.createDataFrame([(1, 4)], "glyph_id long, n int"))
    assert sorted((r.x, r.y, r.w, r.h, r.how) for r in cut.collect()) == [(0, 0, 10, 10, "even"), (10, 0, 10, 10, "even"), (20, 0, 10, 10, "even"), (30, 0, 12, 10, "even")]


def test_files_come_back(spark, tmp_path):
    entries = catalog.QUERIES["feedback_saved"](spark, DATA).withColumns({"adjusted": F.lit(True), "rect": F.array(F.lit(1), F.lit(2))})
    for _ in range(2):
        files.append_feedback(entries, f"{tmp_path}/log")
    assert files.feedback_log(spark, f"{tmp_path}/log").count() == 2 * entries.count()
    records = spark.createDataFrame([("a1", "draw", "1+2"), ("a2", "upload", "3")], "analysis_id string, input_mode string, expression string")
    files.write_analyses(records, f"{tmp_path}/analyses")
    assert files.analysis(spark, f"{tmp_path}/analyses", "a1").first().expression == "1+2" and files.analysis(spark, f"{tmp_path}/analyses", "zz").count() == 0
    log = spark.createDataFrame([(1, 0.5, 0.9)], "epoch int, loss double, accuracy double")
    files.append_training_log(log, f"{tmp_path}/train")
    files.append_training_log(log, f"{tmp_path}/train")
    assert [tuple(r) for r in files.training_log(spark, f"{tmp_path}/train", "epoch int, loss double, accuracy double").collect()] == [(1, 0.5, 0.9)] * 2
    names = lambda *rows: spark.createDataFrame([(list(r),) for r in rows], "class_names array<string>")
    assert files.class_names(names(), names("abcdefghijklmnop")).first()[0] == list("abcdefghijklmnop")
    assert files.class_names(names("ab"), names("abcdefghijklmnop")).first()[0] == list("0123456789+-*/()")
    assert files.class_names(names("ab"), names(), None).first()[0] == ["a", "b"]
    version = lambda *v: spark.createDataFrame([(x,) for x in v], "version string")
    assert [files.is_current(version(*v), "v2").first()[0] for v in (("v2 ",), ("v1",), ())] == [True, False, False]
    files.write_summary(log, f"{tmp_path}/summary")
    assert spark.read.json(f"{tmp_path}/summary").first().epoch == 1
    assert spark.range(1).select(files.data_uri(F.lit(b"abc")), files.data_uri(F.lit(None).cast("binary"))).first()[:] == ("data:image/png;base64,YWJj", "")


def test_drawn_symbols_look_like_what_they_are(spark):
    from inkframe.operators import drawing

    drawn = lambda: drawing.drawn(drawing.parameters(spark.range(40).toDF("number"))).withColumn("glyph_id", F.expr("ascii(symbol) * 1000L + number"))
    pixels = drawn()
    assert pixels.count() == 6 * 40 * 784 and pixels.exceptAll(drawn()).count() == 0
    ink = F.col("v") >= 128
    rows = P.glyph_features(pixels.select("glyph_id", "y", "x", "v"), ink).select("glyph_id", "aspect", "diag_primary", "diag_secondary").collect()
    by = {}
    for r in rows:
        by.setdefault(chr(r.glyph_id // 1000), []).append(r)
    assert sorted(by) == sorted("+-*/()") and all(len(v) == 40 for v in by.values())
    assert all(r.aspect < 0.7 for r in by["("] + by[")"]) and all(r.aspect > 2 for r in by["-"]) and all(0.6 < r.aspect < 1.6 for r in by["+"] + by["*"])
    assert all(r.diag_secondary > r.diag_primary + 0.1 for r in by["/"])
    assert P.holes(pixels.select("glyph_id", "y", "x", "v"), ink).count() == 0
    # a parenthesis bends: its ends lie on one side of its middle, however it is turned
    places = pixels.filter(ink).groupBy("symbol", "number").agg(F.collect_list(F.struct("y", "x")).alias("at")).filter("symbol in ('(', ')')").collect()
    for r in places:
        top, bottom = min(p.y for p in r["at"]), max(p.y for p in r["at"])
        mean = lambda lo, hi: (lambda xs: sum(xs) / len(xs))([p.x for p in r["at"] if lo <= p.y <= hi])
        bend = (mean(top, top + 1) + mean(bottom - 1, bottom)) / 2 - mean((top + bottom) // 2 - 1, (top + bottom + 1) // 2 + 1)
        assert bend > 0.3 if r.symbol == "(" else bend < -0.3, (r.symbol, r.number, bend)


def test_only_holes_and_parts_of_some_area_count(spark):
    """Outlines of holes by their ink: one pixel 2, two 4, three in a row 6, four in a square 7, eight around an island more."""
    pictures = {1: ["#####", "#.###", "#####"], 2: ["######", "#..###", "######"], 3: ["#####", "#...#", "#####"], 4: ["####", "#..#", "#..#", "####"], 5: ["#####", "#...#", "#.#.#", "#...#", "#####"], 6: ["#####", "#...."], 7: ["....", "...."], 8: ["####", "#.##", "##.#", "####"]}
    rows = [(k, y, x, int(c == "#")) for k, a in pictures.items() for y, line in enumerate(a) for x, c in enumerate(line)]
    df = spark.createDataFrame(rows, "glyph_id long, y long, x long, v int")
    ink = F.col("v") == 1
    assert {r.glyph_id: r.n_holes for r in P.hole_counts(df, ink).collect()} == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 0, 7: 0, 8: 0}
    assert {r.glyph_id: r.n_parts for r in P.part_counts(df, ink).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 0, 8: 1}
    assert {r.glyph_id: r.n_parts for r in P.part_counts(df, ~ink).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0, 7: 1, 8: 0}
