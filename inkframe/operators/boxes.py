"""Sets of boxes, grouped by image: rows, medians, containment, merging, scoring.

Everything of one image meets in one shuffle by image_id; windows and groups reuse it. What depends
on its own order, as the greedy merge does, is a fold over an image's sorted boxes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import let
from ..functions.geometry import Box, broken, inside, line_like, overlap_ratio, pair_measures, pair_rules, union

def _image():
    return Window.partitionBy("image_id")


def medians(boxes: DataFrame) -> DataFrame:
    """Exact medians and spreads of each image's boxes."""
    b = Box()
    return boxes.groupBy("image_id").agg(
        F.count("*").alias("n"), F.median("w").alias("med_w"), F.median("h").alias("med_h"), F.median(b.area).alias("med_area"),
        F.stddev_pop("w").alias("std_w"), F.median(b.w / F.greatest(F.lit(1), b.h)).alias("med_aspect"))


def row_snap() -> Column:
    return F.greatest(F.lit(10), F.floor(F.median("h").over(_image()) * 0.6))


def rows(boxes: DataFrame) -> DataFrame:
    """``boxes`` with line: a new row starts where the y-centre steps by more than the snap."""
    order = _image().orderBy("cy", "glyph_id")
    step = F.col("cy") - F.lag("cy").over(order)
    return (boxes.withColumn("cy", Box().center_y).withColumn("snap", row_snap()).withColumn("new", F.coalesce((step > F.col("snap")).cast("int"), F.lit(0)))
            .withColumn("line", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """``rows`` with place: top to bottom, then left to right."""
    return rows(boxes).withColumn("place", F.row_number().over(_image().orderBy("line", "x", "glyph_id")))


def _pairs(boxes: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    a = boxes.select("image_id", *[F.col(c).alias(f"a_{c}") for c in ("glyph_id", "x", "y", "w", "h")])
    b = boxes.select(F.col("image_id").alias("b_image"), *[F.col(c).alias(f"b_{c}") for c in ("glyph_id", "x", "y", "w", "h")])
    return a.join(b, (F.col("image_id") == F.col("b_image")) & (F.col("a_glyph_id") != F.col("b_glyph_id")) & condition, how)


def contained(boxes: DataFrame, pad: int = 1) -> DataFrame:
    """(image_id, inner, outer) pairs."""
    return _pairs(boxes, inside(Box("a_"), Box("b_"), pad)).select("image_id", F.col("a_glyph_id").alias("inner"), F.col("b_glyph_id").alias("outer"))


def without_wrappers(boxes: DataFrame) -> DataFrame:
    """Boxes but those that wrap several others, and small ones inside another."""
    w = boxes.withColumns({"med_w": F.median("w").over(_image()), "med_h": F.median("h").over(_image()), "area": Box().area}).withColumn("med_a", F.median("area").over(_image()))
    pairs = contained(boxes, 1)
    area = boxes.select("glyph_id", Box().area.alias("other"))
    holds = pairs.join(area.withColumnRenamed("glyph_id", "inner"), "inner").groupBy(F.col("outer").alias("glyph_id")).agg(F.count("*").alias("n_in"), F.sum("other").alias("area_in"))
    held = pairs.join(area.withColumnRenamed("glyph_id", "outer"), "outer").groupBy(F.col("inner").alias("glyph_id")).agg(F.min("other").alias("least_out"))
    b = Box()
    big = (b.w >= F.greatest(F.lit(72.0), F.col("med_w") * 1.6)) | (b.h >= F.greatest(F.lit(72.0), F.col("med_h") * 1.4)) | (F.col("area") >= F.greatest(F.lit(1800.0), F.col("med_a") * 2))
    wraps = (F.col("n_in") >= 2) & big  # without a picture the fill ratio is 0, which satisfies the third test
    small = (F.col("area") <= F.least(F.greatest(F.lit(900.0), F.col("med_a") * 0.45), F.col("least_out") * 0.38)) & ((b.w <= F.greatest(F.lit(18.0), F.col("med_w") * 0.42)) | (b.h <= F.greatest(F.lit(24.0), F.col("med_h") * 0.42)))
    kept = w.join(holds, "glyph_id", "left").join(held, "glyph_id", "left").filter(~F.coalesce(wraps, F.lit(False)) & ~F.coalesce(small, F.lit(False)))
    return kept.select(*boxes.columns)


def clear_of(boxes: DataFrame, most: float = 0.72) -> DataFrame:
    """Boxes that no box with a smaller id overlaps by ``most`` or more."""
    a = boxes.alias("a")
    b = boxes.select(F.col("image_id").alias("b_image"), *[F.col(c).alias(f"b_{c}") for c in ("glyph_id", "x", "y", "w", "h")])
    return a.join(b, (F.col("image_id") == F.col("b_image")) & (F.col("b_glyph_id") < F.col("glyph_id")) & (overlap_ratio(Box(), Box("b_")) >= most), "left_anti")


def size_filter(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes that are neither tiny, residual lines, nor specks at the picture's border (the tests that need no pixels)."""
    b = Box()
    w = boxes.withColumns({"med_w": F.median("w").over(_image()), "med_h": F.median("h").over(_image()), "med_a": F.median(b.area).over(_image())})
    least = max(6, int(height * width * 0.00004))
    mx, my = max(6, int(width * 0.02)), max(6, int(height * 0.02))
    border = (b.x <= mx) | (b.y <= my) | (b.right >= width - mx) | (b.bottom >= height - my)
    tiny = (b.area < least) & (b.area < F.col("med_a") * 0.08)
    aspect = b.w / F.greatest(F.lit(1), b.h)
    line = (aspect >= 6) & (b.w >= F.greatest(F.lit(width * 0.18), F.col("med_w") * 1.4)) & (b.h <= F.greatest(F.lit(18.0), F.col("med_h") * 0.65))
    speck = border & (b.area < F.greatest(F.lit(least), F.col("med_a") * 0.12)) & (b.w < F.col("med_w") * 0.75) & (b.h < F.col("med_h") * 0.75)
    return w.filter(~tiny & ~line & ~speck).select(*boxes.columns)


def line_share(boxes: DataFrame, width: int, height: int) -> DataFrame:
    like = line_like(Box(), width, height)
    return boxes.groupBy("image_id").agg(F.count_if(like).alias("n_line_like"), F.avg(like.cast("double")).alias("line_share"))


# What counts for and against a candidate's boxes.
CANDIDATE = {
    "count": 2.2, "count_cap": 18.0, "span": 6.0, "span_cap": 5.0, "height": 30.0, "height_cap": 4.0, "row_base": 2.5, "row": 4.0, "fill": 4.0, "fill_cap": 2.0, "line": 3.5, "tiny": 22.0, "width_cv": 0.90, "width_cv_weight": 4.0,
    "height_cv": 0.75, "height_cv_weight": 4.0, "aspect": 0.36, "aspect_weight": 18.0, "slim": 0.20, "slim_weight": 22.0, "touch": 0.8, "region": 0.45, "region_weight": 10.0,
}


def candidate_scores(boxes: DataFrame, width: int, height: int, weights: dict[str, float] = CANDIDATE) -> DataFrame:
    """(image_id, n, span_ratio, score) of each candidate (image_id) of two boxes or more, with fill, and region_frac, the
    region's share of the picture (0 for none): count, span, height, evenness and fill speak for it; clutter against it."""
    b, k = Box(), weights
    w = boxes.withColumns({"mw": F.median("w").over(_image()), "mh": F.median("h").over(_image()), "ma": F.median(b.area).over(_image())})
    tiny = (b.w <= F.greatest(F.lit(18.0), F.col("mw") * 0.42)) | (b.h <= F.greatest(F.lit(24.0), F.col("mh") * 0.42)) | (b.area <= F.greatest(F.lit(180.0), F.col("ma") * 0.28))
    touch = (b.x <= 1) | (b.y <= 1) | (b.right >= width - 1) | (b.bottom >= height - 1)
    g = w.groupBy("image_id").agg(
        F.count("*").alias("n"), F.first("mw").alias("mw"), F.first("mh").alias("mh"), ((F.max(b.right) - F.min("x")) / float(width)).alias("span"), F.median("fill").alias("fill"), F.first("region_frac").alias("region"),
        F.stddev_pop(b.center_y).alias("sy"), F.stddev_pop("w").alias("sw"), F.stddev_pop("h").alias("sh"),
        F.avg((b.w / F.greatest(F.lit(1), b.h) < k["slim"]).cast("double")).alias("slim"), F.avg(tiny.cast("double")).alias("tiny"),
        F.count_if(line_like(b, width, height)).alias("lines"), F.count_if(touch).alias("touch")).filter("n >= 2")
    high, wide, c = F.greatest(F.lit(1.0), F.col("mh")), F.greatest(F.lit(1.0), F.col("mw")), F.col
    over = lambda value, name: F.greatest(F.lit(0.0), value - k[name]) * k[f"{name}_weight"]
    most = lambda value, name: F.least(F.lit(k[f"{name}_cap"]), value * k[name])
    score = (
        most(c("n"), "count") + most(c("span"), "span") + most(c("mh") / height, "height") + F.greatest(F.lit(0.0), k["row_base"] - c("sy") / high * k["row"]) + most(c("fill"), "fill")
        - c("lines") * k["line"] - c("tiny") * k["tiny"] - over(c("sw") / wide, "width_cv") - over(c("sh") / high, "height_cv")
        - F.greatest(F.lit(0.0), k["aspect"] - c("mw") / high) * k["aspect_weight"] - over(c("slim"), "slim") - c("touch") * k["touch"] - over(c("region"), "region"))
    return g.select("image_id", "n", F.col("span").alias("span_ratio"), score.alias("score"))


def dominant_row(boxes: DataFrame) -> DataFrame:
    """Of each image the fullest row, ties to the larger area then the upper row, if it holds enough of the boxes."""
    per = rows(boxes).groupBy("image_id", "line").agg(F.count("*").alias("n"), F.sum(Box().area).alias("area"))
    ranked = per.withColumn("rank", F.row_number().over(_image().orderBy(F.desc("n"), F.desc("area"), "line"))).withColumn("total", F.sum("n").over(_image()))
    return ranked.filter((F.col("rank") == 1) & (F.col("n") >= F.greatest(F.lit(3), F.bround(F.col("total") / 2).cast("int")))).select("image_id", "line", "n", "area")


def validation(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, reason): the first test that an image's boxes fail, or Valid generic region result."""
    b = Box()
    order = _image().orderBy("cy")
    snap = F.greatest(F.lit(18), F.floor(F.median("h").over(_image()) * 0.70))
    step = boxes.withColumns({"cy": b.center_y, "snap": snap}).withColumn("step", F.col("cy") - F.lag("cy").over(order))
    g = step.groupBy("image_id").agg(
        (F.count_if(F.col("step") > F.col("snap")) + 1).alias("rows"), F.count("*").alias("n"), F.median("h").alias("mh"), F.median("w").alias("mw"), F.stddev_pop("w").alias("sw"),
        F.count_if(line_like(b, width, height)).alias("lines"), F.avg((b.w / F.greatest(F.lit(1), b.h) < 0.18).cast("double")).alias("slim"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    c = F.col
    # At most two rows; half of the boxes, and two, are lines; 18 boxes of which 55 % are slim; widths that spread by 18 and 2.2 medians
    reason = (
        F.when(c("n") < 2, text("Too few rects (", c("n"), " < 2)")).when(c("mh") <= 0, "Invalid median height").when(c("rows") > 2, text("Too many rows (", c("rows"), ")"))
        .when(c("lines") >= F.greatest(F.lit(2), F.bround(c("n") * 0.50).cast("int")), text("Line dominated (", c("lines"), "/", c("n"), ")"))
        .when((c("n") >= 18) & (c("slim") >= 0.55), text("Vertical-guide dominated (", F.format_number("slim", 2), ")"))
        .when(c("sw") > F.greatest(F.lit(18.0), c("mw") * 2.2), "Widths too inconsistent").otherwise("Valid generic region result"))
    return g.select("image_id", reason.alias("reason"))


def middle_width(boxes: DataFrame) -> DataFrame:
    """The median width of the middle half of an image's boxes, by width."""
    g = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list("w")).alias("ws"), F.count("*").cast("int").alias("n"))
    lo, hi = F.floor(F.col("n") / 4).cast("int"), F.least(F.col("n") - 1, F.floor(F.col("n") * 3 / 4).cast("int"))
    mid = F.slice("ws", lo + 1, hi - lo + 1)
    k = F.size(mid)
    at = lambda i: F.element_at(mid, i.cast("int"))
    return g.select("image_id", "n", ((at(F.floor((k + 1) / 2)) + at(F.floor(k / 2) + 1)) / 2.0).alias("mid_w"))


def merged_intervals(boxes: DataFrame, gap: int) -> DataFrame:
    """Horizontal intervals of each image, joined where less than ``gap`` lies between them."""
    order = _image().orderBy("x", "glyph_id")
    end = F.max(Box().right).over(order.rowsBetween(Window.unboundedPreceding, -1))
    isle = boxes.withColumn("new", F.when(F.col("x") - end <= gap, 0).otherwise(1)).withColumn("isle", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return isle.groupBy("image_id", "isle").agg(F.min("x").alias("x0"), F.max(Box().right).alias("x1"), F.count("*").alias("n")).drop("isle")


def adjacent(boxes: DataFrame) -> DataFrame:
    """Neighbours in a row with the gap between them."""
    r = rows(boxes)
    order = Window.partitionBy("image_id", "line").orderBy("x", "glyph_id")
    return r.withColumn("next_id", F.lead("glyph_id").over(order)).withColumn("gap", F.lead("x").over(order) - Box().right).filter("next_id is not null").select("image_id", "line", "glyph_id", "next_id", "gap")


def split_counts(boxes: DataFrame) -> DataFrame:
    """Boxes so wide against the median that they hold several characters, and how many."""
    from ..functions.geometry import char_count

    w = boxes.withColumns({"mw": F.median("w").over(_image()), "mh": F.median("h").over(_image()), "n": F.count("*").over(_image())})
    ratio = F.col("w") / F.greatest(F.lit(1.0), F.col("mw"))
    return w.filter((F.col("n") >= 2) & (F.col("w") >= F.col("mw") * 1.7) & (F.col("h") >= F.col("mh") * 0.5)).select("image_id", "glyph_id", char_count(ratio).alias("n_chars"))


def merge_broken(boxes: DataFrame) -> DataFrame:
    """(image_id, x, y, w, h, n_parts): parts of broken strokes merged, left to right, to a fixed point.

    Each box takes in the first unused one that is ``broken`` off what it has become, and looks again from the left.
    The outcome depends on this order, so an image is one fold over its sorted boxes."""
    g = boxes.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("x", "glyph_id", "y", "w", "h"))).alias("r"), F.median("w").alias("mw"), F.median("h").alias("mh"))
    places = F.sequence(F.lit(0), F.size("r") - 1)
    used = F.transform("r", lambda _: F.lit(False))
    none = F.expr("cast(array() as array<struct<x:bigint,y:bigint,w:bigint,h:bigint,n:int>>)")
    as_box = lambda b, n: F.struct(*[b[c].cast("long").alias(c) for c in "xywh"], n.cast("int").alias("n"))
    mark = lambda flags, at: F.transform(flags, lambda u, k: u | (k == at))

    def absorbed(state: Column, _: Column) -> Column:
        box = state["box"]
        fits = lambda k: ~F.get(state["used"], k) & let([F.get("r", k)], lambda o: broken(pair_measures(Box(box), Box(o), mw=F.col("mw"), mh=F.col("mh"))))
        found = F.when(state["go"], F.try_element_at(F.filter(places, fits), F.lit(1)))
        still = F.struct(box.alias("box"), state["used"].alias("used"), F.lit(False).alias("go"))

        def grown(at: Column, other: Column) -> Column:
            both = let([F.struct(*union(Box(box), Box(other)))], lambda u: as_box(u, box["n"] + 1))
            return F.when(at.isNull(), still).otherwise(F.struct(both.alias("box"), mark(state["used"], at).alias("used"), F.lit(True).alias("go")))

        return let([found], lambda at: let([at, F.get("r", at)], grown))

    def step(state: Column, i: Column) -> Column:
        own = F.get("r", i)
        first = F.struct(as_box(own, F.lit(1)).alias("box"), mark(state["used"], i).alias("used"), F.lit(True).alias("go"))
        done = let([F.aggregate(places, first, absorbed)], lambda d: F.struct(d["used"].alias("used"), F.concat(state["out"], F.array(d["box"])).alias("out")))
        return F.when(F.get(state["used"], i), state).otherwise(done)

    out = F.aggregate(places, F.struct(used.alias("used"), none.alias("out")), step, lambda s: s["out"])
    return g.select("image_id", F.explode(out).alias("b")).select("image_id", *[F.col(f"b.{c}").alias(c) for c in "xywh"], F.col("b.n").cast("long").alias("n_parts"))


#: How ink measures of two neighbours are found: from their boxes to fill, holes and parts of what both span, and to the smaller one's own measures.
Ink = Callable[[Box, Box], dict[str, Column]]


def neighbours(boxes: DataFrame, ink: Ink) -> DataFrame:
    """Each box with the next one to the right (``b_``) and, a column each, whether a pair rule makes them one character."""
    order = _image().orderBy("x", "glyph_id")
    w = boxes.withColumns({f"b_{c}": F.lead(c).over(order) for c in ("glyph_id", *"xywh")} | {"mw": F.median("w").over(_image()), "mh": F.median("h").over(_image())})
    a, b = Box(), Box("b_")
    rules = pair_rules(pair_measures(a, b, mw=F.col("mw"), mh=F.col("mh"), **ink(a, b)))
    return w.withColumns({name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()})


PAIR_RULES = ("digit", "top_bar", "satellite", "short_left", "staggered", "offset", "inline", "corner")


def merge_digit_pairs(boxes: DataFrame, ink: Ink, passes: int = 4) -> DataFrame:
    """Neighbouring fragments merged by the pair rules, in at most ``passes`` passes.

    In a pass a merged pair is passed over, so of a run of pairs that fit every other one is merged; an image of n
    boxes has at most n - 1 passes, and more passes than it needs change nothing."""
    boxes = boxes.withColumn("n_all", F.count("*").over(_image()))
    for k in range(passes):
        order = _image().orderBy("x", "glyph_id")
        fits = reduce(lambda p, q: p | q, [F.col(c) for c in PAIR_RULES])
        w = neighbours(boxes, ink).withColumn("fits", fits & (F.lit(k) < F.greatest(F.lit(1), F.col("n_all") - 1)))
        w = w.withColumn("place", F.row_number().over(order)).withColumn("last", F.coalesce(F.max(F.when(~F.col("fits"), F.col("place"))).over(order), F.lit(0)))
        taken = F.col("fits") & ((F.col("place") - F.col("last")) % 2 == 1)
        w = w.withColumn("taken", taken).withColumn("group", F.col("place") - F.coalesce(F.lag("taken").over(order), F.lit(False)).cast("int"))
        boxes = w.groupBy("image_id", "group").agg(
            F.min("glyph_id").alias("glyph_id"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(Box().right).alias("r"), F.max(Box().bottom).alias("b"), F.first("n_all").alias("n_all")
        ).select("image_id", "n_all", "glyph_id", "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"))
    return boxes.drop("n_all")


def _with_medians(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"mw": F.median("w").over(_image()), "mh": F.median("h").over(_image()), "ma": F.median(Box().area).over(_image()), "mcy": F.median(Box().center_y).over(_image())})


def _drops(b: Box, width: int, height: int) -> Column:
    """Tiny boxes, ink from the page behind, residual lines, specks and thin strokes at the border; needs fill and is_seven."""
    mw, mh, ma, fill = (F.col(c) for c in ("mw", "mh", "ma", "fill"))
    least = max(6, int(height * width * 0.00004))
    mx, my = max(6, int(width * 0.02)), max(6, int(height * 0.02))
    border = (b.x <= mx) | (b.y <= my) | (b.right >= width - mx) | (b.bottom >= height - my)
    wide, tall = b.w / F.greatest(F.lit(1), b.h), b.h / F.greatest(F.lit(1), b.w)
    return (
        ((b.area < least) & (b.area < ma * 0.08))
        | ((fill < 0.06) & (b.area > least * 2) & ~F.col("is_seven"))
        | ((wide >= 6) & (b.w >= F.greatest(F.lit(width * 0.18), mw * 1.4)) & (b.h <= F.greatest(F.lit(18.0), mh * 0.65)) & (fill <= 0.55))
        | (border & (b.area < F.greatest(F.lit(float(least)), ma * 0.12)) & (b.w < mw * 0.75) & (b.h < mh * 0.75))
        | (border & (fill <= 0.35) & (((wide >= 4.5) & (b.w >= mw * 1.2)) | ((tall >= 4.5) & (b.h >= mh * 1.2))))
    )


def ink_filter(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """``boxes`` (with fill and is_seven) without noise."""
    return _with_medians(boxes).filter(~_drops(Box(), width, height)).select(*boxes.columns)


def operator_filter(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """``ink_filter`` that also keeps what may be a dash, a dot or a slim operator near the row; equal boxes once."""
    b, mw, mh, fill = Box(), F.col("mw"), F.col("mh"), F.col("fill")
    near = F.abs(b.center_y - F.col("mcy")) <= F.greatest(F.lit(12.0), mh * 0.9)
    dash = (b.w >= F.greatest(F.lit(6.0), mw * 0.35)) & (b.w <= F.greatest(F.lit(28.0), mw * 1.8)) & (b.h <= F.greatest(F.lit(12.0), mh * 0.45)) & (fill >= 0.18)
    dot = (b.area >= 4) & (b.w <= F.greatest(F.lit(10.0), mw * 0.5)) & (b.h <= F.greatest(F.lit(10.0), mh * 0.5)) & (fill >= 0.12)
    slim = (b.w <= F.greatest(F.lit(14.0), mw * 0.7)) & (b.h >= F.greatest(F.lit(10.0), mh * 0.45)) & (b.h <= F.greatest(F.lit(28.0), mh * 1.4)) & (fill >= 0.12)
    kept = _with_medians(boxes).filter(~_drops(b, width, height) | (near & (dash | dot | slim)))
    return kept.groupBy("image_id", *"xywh").agg(F.min("glyph_id").alias("glyph_id"))


def band_filter(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes that fit a ruled band, in two steps: by the band's size, then by the medians of what is left."""
    b, fill = Box(), F.col("fill")
    first = boxes.filter(
        (b.area >= max(20, int(height * width * 0.00012))) & (fill >= 0.05) & ~((b.w >= width * 0.45) & (b.h <= max(18, int(height * 0.16)))) & (b.w <= max(120, int(height * 1.0)))
        & ~((b.h < max(12, int(height * 0.15))) & (fill < 0.20)) & ~((b.h < max(18, int(height * 0.22))) & (fill < 0.15)) & (b.h <= int(height * 0.92)))
    mw, mh, ma = F.col("mw"), F.col("mh"), F.col("ma")
    side = (b.x <= width * 0.03) | (b.right >= width * (1.0 - 0.03))
    edge = (b.y <= height * 0.08) | (b.bottom >= height * (1.0 - 0.08))
    out = (edge & (b.h >= mh * 1.30) & (b.area >= ma * 1.30)) | (side & (b.w >= mw * 1.45) & (b.h >= mh * 1.15)) | ((edge | side) & ((b.w >= mw * 1.85) | (b.h >= mh * 1.80)))
    return _with_medians(first).filter(~out).select(*boxes.columns)


def spread(c: Column) -> Column:
    """The standard deviation of whole numbers from their exact sums, so that it doesn't depend on the rows' order."""
    v, n = c.cast("decimal(18,0)"), F.count(c)
    return F.sqrt((n * F.sum(v * v) - F.sum(v) * F.sum(v)).cast("double")) / n


def band_validation(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, reason): the first test that a band's boxes (with score) fail, or Valid band result."""
    mh = F.median("h")
    n = boxes.groupBy("image_id").agg(F.count("*").alias("n"), F.first("score").alias("score"), mh.alias("mh"), spread(F.col("h")).alias("sh"), F.count_if(line_like(Box(), width, height)).alias("lines"))
    order = _image().orderBy("cy")
    snap = F.greatest(F.lit(18), F.floor(F.median("h").over(_image()) * 0.65))
    step = boxes.withColumns({"cy": Box().center_y, "snap": snap}).withColumn("step", F.col("cy") - F.lag("cy").over(order))
    rows_ = step.groupBy("image_id").agg((F.count_if(F.col("step") > F.col("snap")) + 1).alias("rows"))
    two = lambda c: F.format_number(c, 2)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    whole = lambda c: F.col(c).cast("string")
    reason = (
        F.when(F.col("n") < 2, text("Too few rects (", whole("n"), " < 2)")).when(F.col("score") < 10.0, text("Score too low (", F.format_number("score", 1), " < 10.0)"))
        .when(F.col("sh") > F.col("mh") * 0.65, text("Heights inconsistent (std/med=", two(F.col("sh") / F.col("mh")), " > 0.4)"))
        .when(F.col("lines") >= F.col("n") * 0.5, text("Line-dominated (", whole("lines"), "/", whole("n"), ")"))
        .when(F.col("rows") > 1, text("Multiple rows detected (", whole("rows"), " > 1)")).otherwise("Valid band result"))
    return n.join(rows_, "image_id").select("image_id", reason.alias("reason"))


def line_dominated(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, dominated): whether lines, or what looks like them, make up an image's boxes."""
    b = Box()
    g = boxes.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(line_like(b, width, height)).alias("lines"), F.median("w").alias("mw"), F.median("h").alias("mh"), F.median(b.w / F.greatest(F.lit(1), b.h)).alias("ratio"))
    flat = (F.col("n") >= 5) & (F.col("mw") >= width * 0.25) & (F.col("mh") <= max(18.0, height * 0.04)) & (F.col("ratio") >= 5.5)
    return g.select("image_id", ((F.col("lines") >= F.greatest(F.lit(3), F.bround(F.col("n") * 0.4).cast("int"))) | flat).alias("dominated"))


def recovered_operators(components_: DataFrame, existing: DataFrame, width: int, height: int) -> DataFrame:
    """Components (image_id, part, x, y, w, h, area, fill) that may be a dash or a slash and that no existing box covers."""
    b = Box()
    real = components_.filter((F.col("area") >= 8) & (b.w >= 2) & (b.h >= 3))
    sizes = lambda d: d.groupBy("image_id").agg(F.median("w").alias("mw"), F.median("h").alias("mh"), F.median(b.center_y).alias("mcy"))
    own, rest = sizes(existing), sizes(real)
    typical = rest.alias("c").join(own.alias("e"), "image_id", "left").select("image_id", *[F.coalesce(f"e.{c}", f"c.{c}").alias(c) for c in ("mw", "mh", "mcy")])
    other = existing.select(F.col("image_id").alias("b_image"), *[F.col(c).alias(f"b_{c}") for c in "xywh"])
    clear = real.join(other, (F.col("image_id") == F.col("b_image")) & (overlap_ratio(b, Box("b_")) >= 0.72), "left_anti").join(typical, "image_id")
    ratio, fill, mw, mh = b.w / F.greatest(F.lit(1), b.h), F.col("fill"), F.col("mw"), F.col("mh")
    near = F.abs(b.center_y - F.col("mcy")) <= F.greatest(F.lit(18.0), mh * 1.05)
    dash = (b.w >= F.greatest(F.lit(10.0), mw * 0.22)) & (b.w <= F.greatest(F.lit(42.0), mw * 1.05)) & (b.h <= F.greatest(F.lit(6.0), mh * 0.18)) & (ratio >= 2.2) & (fill >= 0.18)
    slash = (
        (b.x > 3) & (b.right < width - 3) & (b.h >= F.greatest(F.lit(24.0), mh * 1.20, F.lit(height * 0.68))) & (b.w >= F.greatest(F.lit(8.0), mw * 0.18)) & (b.w <= F.greatest(F.lit(28.0), mw * 0.85))
        & (ratio <= 0.42) & fill.between(0.08, 0.40))
    return clear.filter(near & (dash | slash)).select(*components_.columns)


def added_clear(first: DataFrame, more: DataFrame, most: float = 0.72) -> DataFrame:
    """Boxes of ``first`` and, one after the other, those of ``more`` (by x, glyph_id) that overlap none kept so far."""
    rect = F.struct("x", "glyph_id", "y", "w", "h")
    kept = first.groupBy("image_id").agg(F.sort_array(F.collect_list(rect)).alias("kept"))
    new = more.groupBy("image_id").agg(F.sort_array(F.collect_list(rect)).alias("new"))
    both = kept.join(new, "image_id", "full")
    none = F.expr("cast(array() as array<struct<x:bigint,glyph_id:bigint,y:bigint,w:bigint,h:bigint>>)")
    covered = lambda acc, r: F.exists(acc, lambda k: overlap_ratio(Box(r), Box(k)) >= most)
    out = F.aggregate(F.coalesce("new", none), F.coalesce("kept", none), lambda acc, r: F.when(covered(acc, r), acc).otherwise(F.concat(acc, F.array(r))))
    return both.select("image_id", F.explode(out).alias("r")).select("image_id", "r.glyph_id", "r.x", "r.y", "r.w", "r.h")


# --- regions (image_id, ord, x0, y0, x1, y1)

def distinct_regions(regions: DataFrame, least_area: int = 64) -> DataFrame:
    """Regions inside the picture's left and upper edge, of some area, each once at its first place."""
    x0, y0 = F.greatest(F.lit(0), F.col("x0").cast("int")), F.greatest(F.lit(0), F.col("y0").cast("int"))
    own = regions.select("image_id", "ord", x0.alias("x0"), y0.alias("y0"), F.greatest(x0 + 1, F.col("x1").cast("int")).alias("x1"), F.greatest(y0 + 1, F.col("y1").cast("int")).alias("y1"))
    big = own.filter((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= least_area)
    return big.groupBy("image_id", "x0", "y0", "x1", "y1").agg(F.min("ord").alias("ord"))


def merged_regions(regions: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """Regions in sorted order, each joined to the last one if they are near in both directions; a fold an image."""
    pad = lambda side: F.first(F.greatest(F.lit(10), F.floor((side if isinstance(side, Column) else F.lit(side)) * 0.02)))
    names = ("x0", "y0", "x1", "y1")
    g = regions.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in names]))).alias("r"), pad(width).alias("px"), pad(height).alias("py"))
    px, py = F.col("px"), F.col("py")

    def step(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        over = lambda lo, hi, pad: (F.least(r[hi], last[hi]) - F.greatest(r[lo], last[lo]) > -pad) & (r[lo] <= last[hi] + pad) & (r[hi] >= last[lo] - pad)
        joined = F.struct(*[f(last[c], r[c]).alias(c) for f, c in zip((F.least, F.least, F.greatest, F.greatest), names)])
        near = F.coalesce(over("x0", "x1", px) & over("y0", "y1", py), F.lit(False))
        return F.when(near, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(r)))

    out = F.aggregate("r", F.expr("cast(array() as array<struct<x0:int,y0:int,x1:int,y1:int>>)"), step)
    return g.select("image_id", F.explode(out).alias("r")).select("image_id", "r.*")


def row_regions(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Padded regions around the rows of boxes that look like characters, of those wide and high enough."""
    b = Box()
    w = boxes.withColumns({"mw": F.median("w").over(_image()), "mh": F.median("h").over(_image())})
    charish = w.filter((b.area >= max(8, int(height * width * 0.00002))) & (b.h >= max(8, int(height * 0.018))) & (b.h <= height * 0.80) & (b.w <= width * 0.75) & ~((b.w / F.greatest(F.lit(1), b.h) > 12) & (b.h < F.col("mh") * 0.7)))
    order = _image().orderBy("cy", "glyph_id")
    stepped = charish.withColumn("cy", b.center_y).withColumn("new", F.coalesce((F.col("cy") - F.lag("cy").over(order) > F.greatest(F.lit(16), F.floor(F.col("mh") * 0.85))).cast("int"), F.lit(0)))
    rowed = stepped.withColumn("line", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    px, py = F.greatest(F.lit(12), F.floor(F.first("mw") * 0.9)), F.greatest(F.lit(12), F.floor(F.first("mh") * 0.9))
    out = rowed.groupBy("image_id", F.col("line").alias("ord")).agg(
        F.greatest(F.lit(0), F.min("x") - px).cast("int").alias("x0"), F.greatest(F.lit(0), F.min("y") - py).cast("int").alias("y0"),
        F.least(F.lit(width), F.max(b.right) + px).cast("int").alias("x1"), F.least(F.lit(height), F.max(b.bottom) + py).cast("int").alias("y1"))
    return out.filter((F.col("x1") - F.col("x0") >= max(28, int(width * 0.08))) & (F.col("y1") - F.col("y0") >= max(24, int(height * 0.05))))


def region_scores(regions: DataFrame, boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(image_id, ord, n, score) of regions (with fg_ratio) by the boxes that lie in them; regions without boxes have none."""
    b = Box()
    inside_ = (b.x >= F.col("x0")) & (b.y >= F.col("y0")) & (b.right <= F.col("x1")) & (b.bottom <= F.col("y1"))
    own = regions.join(boxes.select("image_id", *"xywh"), "image_id").filter(inside_)
    part = Window.partitionBy("image_id", "ord")
    w = own.withColumns({"mw": F.median("w").over(part), "mh": F.median("h").over(part)})
    rw, rh = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    one = lambda c: F.greatest(F.lit(1.0), c.cast("double"))
    g = w.groupBy("image_id", "ord").agg(
        F.count("*").alias("n"), F.first("mw").alias("mw"), F.first("mh").alias("mh"), F.first(rw).alias("rw"), F.first(rh).alias("rh"), F.first("fg_ratio").alias("fg"),
        F.count_if((b.w * 25 >= rw * 7) & (b.h <= F.greatest(F.lit(10.0), F.col("mh") * 0.45))).alias("lines"), (F.max(b.right) - F.min("x")).alias("sx"), (F.max(b.bottom) - F.min("y")).alias("sy"), (spread(b.center_y * 2) / 2).alias("jitter"))
    c = F.col
    most = lambda cap, v: F.least(F.lit(cap), v)
    score = (
        most(8.0, c("n") * 1.5) + most(4.0, c("sx") / one(c("rw")) * 5.0) + most(4.0, c("rw") / one(c("rh")) * 0.6) + most(4.0, c("sx") * c("sy") / one(c("rw") * c("rh")) * 5.0) - most(6.0, c("lines") * 1.5)
        - F.abs(c("fg") - 0.18) * 8.0 - most(4.0, c("jitter") / one(c("mh")) * 2.5) - F.abs(c("mw") - c("mh")) / one(c("mh")) * 0.8 - F.greatest(F.lit(0.0), c("rw") * c("rh") / float(width * height) - 0.45) * 10.0)
    return g.select("image_id", "ord", "n", score.alias("score"))


def preferred(candidates: DataFrame) -> DataFrame:
    """Of each image's candidates (name, n, score, span_ratio) the best; a region that has three boxes more at little cost comes first."""
    best = Window.partitionBy("image_id").orderBy(F.desc("score"), F.desc("n"), F.desc("span_ratio"), "name")
    whole = Window.partitionBy("image_id")
    region = lambda c: F.max(F.when(F.col("name") == "region", F.col(c))).over(whole)
    w = candidates.withColumn("k", F.row_number().over(best)).withColumns({f"r_{c}": region(c) for c in ("n", "score", "span_ratio")})
    top = w.filter("k = 1")
    swap = (F.col("name") != "region") & (F.col("r_n") - F.col("n") >= 3) & (F.col("score") - F.col("r_score") <= 1.5) & (F.col("r_span_ratio") >= F.col("span_ratio") - 0.03)
    return top.select("image_id", F.when(swap, "region").otherwise(F.col("name")).alias("name"))


def row_reach(boxes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(image_id, x0, x1): how far the boxes of one row reach to both sides of a seed (image_id, x0, x1), over gaps of
    at most 26 pixels or 3.2 median widths. Boxes in one row join in the order of the line, so gaps make islands."""
    gap = F.greatest(F.lit(26), F.floor(F.median("w").over(_image()) * 3.2))
    order = _image().orderBy("x", "glyph_id")
    end = F.max(Box().right).over(order.rowsBetween(Window.unboundedPreceding, -1))
    isles = boxes.withColumn("gap", gap).withColumn("new", F.when(F.col("x") - end <= F.col("gap"), 0).otherwise(1)).withColumn("isle", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = isles.groupBy("image_id", "isle").agg(F.min("x").alias("a"), F.max(Box().right).alias("b"), F.first("gap").alias("gap"))
    met = seeds.join(span, "image_id", "left").withColumn("near", (F.col("a") - F.col("x1") <= F.col("gap")) & (F.col("x0") - F.col("b") <= F.col("gap")))
    return met.groupBy("image_id", "x0", "x1").agg(F.min(F.when(F.col("near"), F.col("a"))).alias("a"), F.max(F.when(F.col("near"), F.col("b"))).alias("b")).select("image_id", F.least("x0", F.coalesce("a", "x0")).alias("x0"), F.greatest("x1", F.coalesce("b", "x1")).alias("x1"))
