"""Pictures as pixel rows (glyph_id, y, x, v): ink, projections, boxes, densities, thresholds, components, features.

A picture is a group; what looks at a picture's neighbours in a row or column is a window, and
connected components are found by numpy in batches of pictures' runs of ink.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import let
from ..sources.staged import staged

INK = 128


def projections(pixels: DataFrame) -> DataFrame:
    """Ink pixels per row of each picture."""
    return pixels.groupBy("glyph_id", "y").agg(F.count_if(F.col("v") >= INK).alias("n_ink"))


def ink_box(pixels: DataFrame) -> DataFrame:
    p = pixels.filter(F.col("v") >= INK)
    return p.groupBy("glyph_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"), F.count("*").alias("n_ink"))


def features(pixels: DataFrame) -> DataFrame:
    """Shares of ink in halves, middle thirds and diagonal quarters of 28 x 28 pictures."""
    ink = (F.col("v") >= INK).cast("double")
    part = lambda c: F.coalesce(F.avg(F.when(c, ink)), F.lit(0.0))
    x, y = F.col("x"), F.col("y")
    return pixels.groupBy("glyph_id").agg(
        F.avg(ink).alias("fill"), part(x < 14).alias("left_half"), part(x >= 14).alias("right_half"), part(y < 14).alias("top_half"), part(y >= 14).alias("bottom_half"),
        part(x.between(9, 18) & y.between(9, 18)).alias("center"), part(y.between(13, 15)).alias("center_row"), part(x.between(13, 15)).alias("center_col"),
        part((x < 14) == (y < 14)).alias("diag_primary"), part((x < 14) != (y < 14)).alias("diag_secondary"))


def otsu(pixels: DataFrame) -> DataFrame:
    """(glyph_id, threshold): the grey level that best parts each picture in two, the lowest of equals."""
    h = pixels.groupBy("glyph_id", "v").agg(F.count("*").alias("n"))
    up = Window.partitionBy("glyph_id").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("glyph_id")
    c = h.withColumns({"n0": F.sum("n").over(up), "s0": F.sum(F.col("n") * F.col("v")).over(up), "n_all": F.sum("n").over(whole), "s_all": F.sum(F.col("n") * F.col("v")).over(whole)})
    apart = F.col("s0") * F.col("n_all") - F.col("s_all") * F.col("n0")
    between = F.try_divide(apart.cast("double") * apart, F.col("n0").cast("double") * (F.col("n_all") - F.col("n0")))
    best = c.withColumn("between", F.round(F.coalesce(between, F.lit(0.0)), 3)).withColumn("k", F.row_number().over(Window.partitionBy("glyph_id").orderBy(F.desc("between"), "v")))
    return best.filter("k = 1").select("glyph_id", F.col("v").alias("threshold"))


def fill_in_boxes(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Ink share inside each box (glyph_id, x0, y0, x1, y1) of its own picture."""
    b = pixels.join(boxes, "glyph_id").filter("x >= x0 and x < x1 and y >= y0 and y < y1")
    return b.groupBy("glyph_id").agg(F.avg((F.col("v") >= INK).cast("double")).alias("fill"))


def column_projections(pixels: DataFrame) -> DataFrame:
    """Ink pixels per column of each picture."""
    return pixels.groupBy("glyph_id", "x").agg(F.count_if(F.col("v") >= INK).alias("n_ink"))


# --- grey and ink

def gray(b: Column, g: Column, r: Column) -> Column:
    """The brightness of a colour, 0 to 255."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(b * 0.114 + g * 0.587 + r * 0.299 + 0.5))).cast("int")


def _picture() -> Window:
    return Window.partitionBy("glyph_id")


def _edges() -> Column:
    """How often a pixel counts in the picture's frame: corners count twice."""
    side = lambda c: (F.col(c) == 0).cast("int") + (F.col(c) == F.max(c).over(_picture())).cast("int")
    return side("y") + side("x")


def polarity(pixels: DataFrame) -> DataFrame:
    """(glyph_id, edge_mean, bright, dark, character): brightness of the frame, shares of bright (180 and up) and dark (to 40) pixels, whether it is 28 x 28."""
    w = pixels.withColumn("e", _edges())
    return w.groupBy("glyph_id").agg((F.sum(F.col("e") * F.col("v")) / F.sum("e")).alias("edge_mean"), F.avg((F.col("v") >= 180).cast("double")).alias("bright"), F.avg((F.col("v") <= 40).cast("double")).alias("dark"), ((F.max("x") == 27) & (F.max("y") == 27)).alias("character"))


def is_white_on_black(edge_mean: Column, bright: Column, dark: Column, character: Column) -> Column:
    """Whether a picture is already a normalised character; one of another size never is."""
    return character & (edge_mean <= 35) & bright.between(0.02, 0.45) & (dark >= 0.45)


def is_normalized(edge_mean: Column, bright: Column, dark: Column) -> Column:
    """Whether a picture is already light ink on a dark ground."""
    return (edge_mean <= 45) & (bright >= 0.01) & (dark >= 0.35)


def ink_map(colours: DataFrame, whole: bool = True) -> DataFrame:
    """(glyph_id, y, x, v): ink as brightness, from colours (b, g, r). Pictures of light ink stay as they are; else the
    darker of grey and of the darkest channel counts. ``whole``: the rule for whole pictures, not for single characters."""
    g = colours.withColumn("v", gray(F.col("b"), F.col("g"), F.col("r")))
    p = polarity(g)
    light = (F.col("edge_mean") <= 35) & (F.col("bright") <= 0.45) if whole else is_white_on_black(F.col("edge_mean"), F.col("bright"), F.col("dark"), F.col("character"))
    dark = F.greatest(255 - F.col("v"), 255 - F.least("b", "g", "r"))
    return g.join(p, "glyph_id").select("glyph_id", "y", "x", F.when(light, F.col("v")).otherwise(dark).cast("int").alias("v"))


def coloured(colours: DataFrame) -> DataFrame:
    """(glyph_id, y, x) of pixels of coloured ink: saturated or spread for their picture, and dark enough."""
    c = colours.withColumn("v", gray(F.col("b"), F.col("g"), F.col("r")))
    top, low = F.greatest("b", "g", "r"), F.least("b", "g", "r")
    sat = F.when(top == 0, 0).otherwise(F.floor((top - low) * 255.0 / top + 0.5)).cast("int")
    c = c.withColumns({"sat": sat, "spread": (top - low).cast("int"), "darkness": (255 - F.col("v")).cast("int")})
    least = c.groupBy("glyph_id").agg(F.greatest(F.lit(18), F.floor(F.percentile("darkness", F.lit(0.55)) * 0.35)).alias("zone"))
    zone = c.join(least, "glyph_id").filter("darkness >= zone")
    clip = lambda column, lo, hi: F.floor(F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), F.percentile(column, F.lit(0.985))))).cast("int")
    t = zone.groupBy("glyph_id").agg(clip("sat", 55, 110).alias("ts"), clip("spread", 20, 48).alias("tp"), F.greatest(F.lit(26), F.floor(F.percentile("darkness", F.lit(0.40)))).alias("td"))
    relaxed = F.greatest(F.lit(32), F.bround(F.col("ts") * 0.45).cast("int"))
    fits = (F.col("darkness") >= F.col("td")) & ((F.col("sat") >= F.col("ts")) | ((F.col("spread") >= F.col("tp")) & (F.col("sat") >= relaxed)))
    return c.join(t, "glyph_id").filter(fits).select("glyph_id", "y", "x")


# --- runs and components

def row_runs(pixels: DataFrame, ink: Column) -> DataFrame:
    """(glyph_id, y, x0, x1) of the runs of ``ink`` pixels in each row, x1 the last one.

    A row's places are gathered and cut where one is missing: no pixel is sorted among all others, and no filter on ``ink`` moves into
    what the pixels are made by."""
    rows = pixels.groupBy("glyph_id", "y").agg(F.sort_array(F.collect_list(F.when(ink, F.col("x")))).alias("xs"))
    return rows.select("glyph_id", "y", F.inline(runs_in("xs")))


def runs_in(places: str) -> Column:
    """[(x0, x1)] of the runs in a sorted list of places."""
    ends = lambda d: F.filter(places, lambda x, k: F.coalesce(F.get(places, k + d) != x + d, F.lit(True)))
    return F.arrays_zip(ends(-1).alias("x0"), ends(1).alias("x1"))


def _pieces(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of pictures that have ``most`` runs together, or of one that has more."""
    end = np.cumsum(pc.list_value_length(batch.column("r")).to_numpy())
    lo = 0
    while lo < len(end):
        hi = max(lo + 1, int(np.searchsorted(end, (end[lo - 1] if lo else 0) + most, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


#: Runs whose parts are found at once; those of one picture always are.
FOLDED = 1_000_000


def labelled_runs(runs: DataFrame, corners: bool = True) -> DataFrame:
    """Runs with part: what hangs together in a picture, over ``corners`` too. Numbered by the part's first run.

    A picture's runs are one row, and the parts of a batch of pictures are found at once: they cost little more than sorting them. Runs of one row don't overlap."""
    own = runs.groupBy("glyph_id").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")]))).alias("r"))
    reach, most = int(corners), FOLDED

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in _pieces(whole, most)):
            r = b.column("r").flatten()
            if len(r):
                n = pc.list_value_length(b.column("r")).to_numpy()
                picture, first = np.repeat(np.arange(len(n)), n), np.repeat(np.cumsum(n) - n, n)
                y, x0, x1 = (r.field(c).to_numpy() for c in ("y", "x0", "x1"))
                # pictures lie below one another, two rows apart
                low, high = np.minimum.reduceat(y, np.cumsum(n) - n).astype(np.int64), np.maximum.reduceat(y, np.cumsum(n) - n).astype(np.int64)
                top = np.cumsum(high - low + 3) - (high - low + 3) - low
                part = hanging_together(y + top[picture], x0, x1, reach) - first
                yield pa.RecordBatch.from_arrays([b.column("glyph_id").take(pa.array(picture)), *[r.field(c) for c in ("y", "x0", "x1")], pa.array(part.astype(np.int32))], ["glyph_id", "y", "x0", "x1", "part"])

    kinds = T.StructType([runs.schema["glyph_id"], *[T.StructField(c, T.IntegerType()) for c in ("y", "x0", "x1", "part")]])
    return own.mapInArrow(labelled, kinds)


def hanging_together(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """Of runs in the order of rows and places, the place of the first run of each one's part.

    Runs that meet in the next row are a stretch of the order. The first runs of two parts that meet are hung to the lesser one, all at once, until none do."""
    n, low = len(y), int(x0.min())
    wide = int(x1.max()) - low + reach + 2
    start, end = (y.astype(np.int64) * wide + x.astype(np.int64) - low for x in (x0, x1))
    first, after = np.searchsorted(end, start + wide - reach), np.searchsorted(start, end + wide + reach, side="right")
    count = np.maximum(after - first, 0)
    u = np.repeat(np.arange(n), count)
    v = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(u))
    part = np.arange(n)
    while True:
        a, b = part[u], part[v]
        apart = a != b
        if not apart.any():
            return part
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(part, np.maximum(a, b), np.minimum(a, b))
        while (part[part] != part).any():
            part = part[part]


def parts_of(pixels: DataFrame, ink: Column, corners: bool = True) -> DataFrame:
    """(glyph_id, part, x, y, w, h, area, cx, cy): the connected parts of ``ink``."""
    return parts_of_runs(labelled_runs(row_runs(pixels, ink), corners))


def parts_of_runs(runs: DataFrame) -> DataFrame:
    """The same of ``labelled_runs``."""
    n = F.col("x1") - F.col("x0") + 1
    g = runs.groupBy("glyph_id", "part").agg(
        F.min("x0").alias("x"), F.min("y").alias("y"), F.max("x1").alias("r"), F.max("y").alias("b"), F.sum(n).alias("area"), F.sum(n * (F.col("x0") + F.col("x1")) / 2).alias("sx"), F.sum(n * F.col("y")).alias("sy"))
    return g.select("glyph_id", "part", "x", "y", (F.col("r") - F.col("x") + 1).alias("w"), (F.col("b") - F.col("y") + 1).alias("h"), "area", (F.col("sx") / F.col("area")).alias("cx"), (F.col("sy") / F.col("area")).alias("cy"))


def holes(pixels: DataFrame, ink: Column) -> DataFrame:
    """(glyph_id, part, x, y, area) of ground that ink shuts in: parts of what is no ink, corners apart, off the frame."""
    size = pixels.groupBy("glyph_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    free = parts_of(pixels, ~ink, corners=False).join(size, "glyph_id")
    return free.filter("x > 0 and y > 0 and x + w - 1 < mx and y + h - 1 < my").select("glyph_id", "part", "x", "y", "area")


# Fixed value: least area of a part or a hole that is counted.
COUNTED = 6


def part_counts(pixels: DataFrame, ink: Column) -> DataFrame:
    """(glyph_id, n_parts) of every picture: parts of six pixels or more."""
    n = parts_of(pixels, ink).groupBy("glyph_id").agg(F.count_if(F.col("area") >= COUNTED).alias("n_parts"))
    return pixels.select("glyph_id").distinct().join(n, "glyph_id", "left").select("glyph_id", F.coalesce("n_parts", F.lit(0)).alias("n_parts"))


def hole_counts(pixels: DataFrame, ink: Column) -> DataFrame:
    """(glyph_id, n_holes) of every picture: holes that an outline through the ink around them gives an area of six or more.

    That outline has the hole's pixels inside and the ink beside them on it, so its area is inside + outline / 2 - 1. Ink within a
    hole counts as outline; a hole that has any is larger than six."""
    size = pixels.groupBy("glyph_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    runs = staged(labelled_runs(row_runs(pixels, ~ink), corners=False), "ground", by="glyph_id").join(size, "glyph_id")
    part = Window.partitionBy("glyph_id", "part")
    inner = runs.withColumns({"x": F.min("x0").over(part), "r": F.max("x1").over(part), "t": F.min("y").over(part), "b": F.max("y").over(part)}).filter("x > 0 and t > 0 and r < mx and b < my")
    # each pixel of a hole, and its four neighbours: a place that is none of the hole's own is beside it
    dots = inner.select("glyph_id", "part", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    steps = F.inline(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit(dy == dx).alias("own")) for dy, dx in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))]))
    places = dots.select("glyph_id", "part", steps).groupBy("glyph_id", "part", "y", "x").agg(F.max("own").alias("own"))
    whole = places.groupBy("glyph_id", "part").agg(F.count_if("own").alias("area"), F.count_if(~F.col("own")).alias("beside"))
    n = whole.groupBy("glyph_id").agg(F.count_if(F.col("area") + F.col("beside") / 2 - 1 >= COUNTED).alias("n_holes"))
    return size.select("glyph_id").join(n, "glyph_id", "left").select("glyph_id", F.coalesce("n_holes", F.lit(0)).alias("n_holes"))


def without_specks(parts: DataFrame, least: int) -> DataFrame:
    """Parts of some area; where a picture has none, its largest, the first of equals."""
    w = parts.withColumns({"k": F.row_number().over(_picture().orderBy(F.desc("area"), "part")), "any": F.max(F.col("area") >= least).over(_picture())})
    return w.filter((F.col("area") >= least) | (~F.col("any") & (F.col("k") == 1))).drop("k", "any")


def dominant_parts(parts: DataFrame) -> DataFrame:
    """A character's largest part and those that belong to it: near it, or large or long for their distance."""
    w = parts.withColumn("k", F.row_number().over(_picture().orderBy(F.desc("area"), "part")))
    main = w.filter("k = 1").select("glyph_id", *[F.col(c).alias(f"m_{c}") for c in ("x", "y", "w", "h", "area")])
    c = F.col
    pad = F.greatest(F.lit(3), F.bround(F.greatest("m_w", "m_h") * 0.55).cast("int"))
    j = w.join(main, "glyph_id").withColumn("pad", pad)
    x0, y0, x1, y1 = c("m_x") - c("pad"), c("m_y") - c("pad"), c("m_x") + c("m_w") + c("pad"), c("m_y") + c("m_h") + c("pad")
    least = F.greatest(F.lit(3), F.bround(c("m_area") * 0.035).cast("int"))
    near_by = lambda d: (c("x") <= x1 + d) & (c("x") + c("w") >= x0 - d) & (c("y") <= y1 + d) & (c("y") + c("h") >= y0 - d)
    centred = (F.abs(c("cx") - (c("m_x") + c("m_w") / 2)) <= F.greatest(F.lit(7.0), c("m_w") * 1.15)) & (F.abs(c("cy") - (c("m_y") + c("m_h") / 2)) <= F.greatest(F.lit(7.0), c("m_h") * 1.15))
    # a part that touches the widened box is near it too, and a long one must be near or centred, so two tests and size remain
    belongs = near_by(2) | centred | (c("area") >= F.greatest(F.lit(6), F.bround(c("m_area") * 0.20).cast("int")))
    return j.filter((c("k") == 1) | ((c("area") >= least) & belongs)).select(*parts.columns)


# --- scores of a threshold

def binary_scores(pixels: DataFrame, ink: Column) -> DataFrame:
    """(glyph_id, score): how well ``ink`` fits a character: a minority of the picture, off its frame, compact. Pictures without ink have none."""
    w = pixels.withColumns({"e": _edges(), "i": ink.cast("int")})
    x, y = (F.when(ink, F.col(c)) for c in "xy")
    g = w.groupBy("glyph_id").agg(F.sum("i").alias("n"), F.count("*").alias("size"), (F.sum(F.col("e") * F.col("i")) / F.sum("e")).alias("edge"), ((F.max(x) - F.min(x) + 1) * (F.max(y) - F.min(y) + 1)).alias("box"))
    return binary_scored(g)


def binary_scored(measures: DataFrame) -> DataFrame:
    """The same of (glyph_id, n, size, edge, box): pixels of ink and all, the frame's share of ink, the area of the ink's box."""
    return measures.filter("n > 0").select("glyph_id", (-F.abs(F.col("n") / F.col("size") - 0.12) - F.col("edge") * 0.8 + F.least(F.col("n") / F.col("box"), F.lit(0.6)) * 0.18).alias("score"))


# The score of a threshold of a whole picture.
THRESHOLD_SCORE = {"share": 0.15, "edge": 0.8, "noise_cap": 80, "noise": 0.01, "line": 0.12, "char_cap": 20, "char": 0.02, "line_width": 0.20, "line_height": (18, 0.03), "char_height": (12, 0.02), "char_width": (24, 0.18)}


def threshold_scores(pixels: DataFrame, ink: Column) -> DataFrame:
    """(glyph_id, score) of a whole picture's ink by its share, frame, specks, lines and characters; null without ink."""
    w = pixels.withColumns({"e": _edges(), "i": ink.cast("int")})
    whole = w.groupBy("glyph_id").agg(F.sum("i").alias("n"), F.count("*").alias("size"), (F.sum(F.col("e") * F.col("i")) / F.sum("e")).alias("edge"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return threshold_scored(whole, parts_of(pixels, ink))


def threshold_scored(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """The same of pictures (glyph_id, n, size, edge, width, height) and their ``parts``."""
    t = THRESHOLD_SCORE
    p = parts.join(whole.select("glyph_id", "size", "width", "height"), "glyph_id")
    least = lambda pair, c: F.greatest(F.lit(pair[0]), F.floor(F.col(c) * pair[1]))
    counts = p.groupBy("glyph_id").agg(
        F.count_if(F.col("area") < F.greatest(F.lit(6), F.floor(F.col("size") * 0.00004))).alias("noise"),
        F.count_if((F.col("w") >= F.col("width") * t["line_width"]) & (F.col("h") <= least(t["line_height"], "height"))).alias("lines"),
        F.count_if((F.col("h") >= least(t["char_height"], "height")) & (F.col("w") <= least(t["char_width"], "width"))).alias("chars"))
    c = F.col
    score = (
        -F.abs(c("n") / c("size") - t["share"]) - c("edge") * t["edge"] - F.least(c("noise"), F.lit(t["noise_cap"])) * t["noise"]
        - c("lines") * t["line"] + F.least(c("chars"), F.lit(t["char_cap"])) * t["char"])
    return whole.join(counts, "glyph_id", "left").select("glyph_id", F.when(c("n") > 0, score).alias("score"))


def best_thresholds(scores: DataFrame) -> DataFrame:
    """(glyph_id, candidate) with the best score, the first of equals; those without ink come last."""
    order = _picture().orderBy(F.desc_nulls_last("score"), "candidate")
    return scores.withColumn("k", F.row_number().over(order)).filter("k = 1").select("glyph_id", "candidate")


# --- ruled lines

def ruled_pixels(pixels: DataFrame, ink: Column, least: int) -> DataFrame:
    """(glyph_id, y, x) of ink in horizontal runs of ``least`` pixels or more."""
    runs = row_runs(pixels, ink).filter(F.col("x1") - F.col("x0") + 1 >= least)
    return runs.select("glyph_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def without_ruled_lines(pixels: DataFrame, ink: Column, width: int) -> DataFrame:
    """(glyph_id, y, x) of ink that is no ruled line, smoothed: what most of the nine pixels around are."""
    size = pixels.groupBy("glyph_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    left = pixels.filter(ink).select("glyph_id", "y", "x").join(ruled_pixels(pixels, ink, max(40, int(width * 0.25))), ["glyph_id", "y", "x"], "left_anti")
    # outside the frame its own pixels count again, so a pixel at the frame speaks for more than one place
    near = lambda c, m: F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)]))
    spread = left.join(size, "glyph_id")
    spread = spread.withColumn("ny", near("y", "my")).withColumn("nx", near("x", "mx")).filter("ny between 0 and my and nx between 0 and mx")
    again = lambda c, n, m: F.when(((F.col(c) == 0) & (F.col(n) == 0)) | ((F.col(c) == F.col(m)) & (F.col(n) == F.col(m))), 2).otherwise(1)
    votes = spread.groupBy("glyph_id", F.col("ny").alias("y"), F.col("nx").alias("x")).agg(F.sum(again("y", "ny", "my") * again("x", "nx", "mx")).alias("votes"))
    return votes.filter("votes >= 5").select("glyph_id", "y", "x")


# --- boxes and features

def content_box(pixels: DataFrame, ink: Column) -> DataFrame:
    """(glyph_id, x0, y0, x1, y1) of the ink; the whole picture without ink."""
    own = lambda f, c: F.coalesce(f(F.when(ink, F.col(c))), f(F.col(c)))
    return pixels.groupBy("glyph_id").agg(own(F.min, "x").alias("x0"), own(F.min, "y").alias("y0"), (own(F.max, "x") + 1).alias("x1"), (own(F.max, "y") + 1).alias("y1"))


def export_box(pixels: DataFrame, pad: int = 24, paper: int = 245) -> DataFrame:
    """(glyph_id, x0, y0, x1, y1) of all that is darker than paper, with a margin inside the picture."""
    size = pixels.groupBy("glyph_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    box = pixels.filter(F.col("v") < paper).groupBy("glyph_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    return box.join(size, "glyph_id").select("glyph_id", F.greatest(F.lit(0), F.col("x0") - pad).alias("x0"), F.greatest(F.lit(0), F.col("y0") - pad).alias("y0"), F.least("w", F.col("x1") + pad).alias("x1"), F.least("h", F.col("y1") + pad).alias("y1"))


def glyph_features(pixels: DataFrame, ink: Column) -> DataFrame:
    """A character's measures inside its content box: size, aspect, holes, and shares of ink in the whole, the halves, the
    middle, the middle rows and columns, and the sums of opposite quarters."""
    c = F.col
    box = content_box(pixels, ink)
    p = pixels.join(box, "glyph_id").withColumn("i", ink.cast("double"))
    p = p.filter("x >= x0 and x < x1 and y >= y0 and y < y1").withColumns({"u": c("x") - c("x0"), "t": c("y") - c("y0"), "cw": c("x1") - c("x0"), "ch": c("y1") - c("y0")})
    part = lambda n, d: F.greatest(F.lit(1), F.floor(c(n) / d))
    half_w, half_h, third_w, third_h = part("cw", 2), part("ch", 2), part("cw", 3), part("ch", 3)
    left, right, top, bottom = c("u") < half_w, c("u") >= c("cw") - half_w, c("t") < half_h, c("t") >= c("ch") - half_h
    middle = lambda v, n: (c(v) >= F.floor(c(n) / 2) - 1) & (c(v) < F.floor(c(n) / 2) + 2)
    share = lambda test: F.coalesce(F.avg(F.when(test, c("i"))), F.lit(0.0))
    g = p.groupBy("glyph_id").agg(
        F.first("cw").alias("content_w"), F.first("ch").alias("content_h"), (F.first("cw") / F.greatest(F.lit(1), F.first("ch"))).alias("aspect"), F.avg("i").alias("fill"),
        share(left).alias("left"), share(right).alias("right"), share(top).alias("top"), share(bottom).alias("bottom"),
        share((c("t") >= third_h) & (c("t") < c("ch") - third_h) & (c("u") >= third_w) & (c("u") < c("cw") - third_w)).alias("center"),
        share(middle("t", "ch")).alias("center_row"), share(middle("u", "cw")).alias("center_col"),
        (share(top & left) + share(bottom & right)).alias("diag_primary"), (share(top & right) + share(bottom & left)).alias("diag_secondary"))
    n = holes(pixels, ink).groupBy("glyph_id").agg(F.count("*").cast("int").alias("holes"))
    return g.join(n.hint("merge"), "glyph_id", "left").withColumn("holes", F.coalesce("holes", F.lit(0)))


def stroke_measures(pixels: DataFrame, ink: Column) -> DataFrame:
    """(glyph_id, aspect, symmetry, density, top, thin): of the ink box, of the middle rows, of rows with ink, of the upper quarter; and whether strokes are thin."""
    h = F.max("y").over(_picture()) + 1
    p = pixels.withColumns({"i": ink.cast("int"), "h": h})
    x, y = (F.when(ink, F.col(c)) for c in "xy")
    bw, bh = F.max(x) - F.min(x) + 1, F.max(y) - F.min(y) + 1
    middle = (F.col("y") >= F.floor(F.col("h") * 0.30)) & (F.col("y") < F.floor(F.col("h") * 0.70))
    upper = F.avg(F.when(F.col("y") < F.floor(F.col("h") / 4), F.col("i").cast("double")))
    n = F.sum("i")
    return p.groupBy("glyph_id").agg(
        F.coalesce(bw / F.greatest(F.lit(1), bh), F.lit(1.0)).alias("aspect"), F.when(n == 0, 0.5).otherwise(F.sum(F.when(middle, F.col("i")).otherwise(0)) / F.greatest(F.lit(1), n)).alias("symmetry"),
        (F.count_distinct(y) / F.first("h")).alias("density"), F.coalesce(upper, F.lit(0.0)).alias("top"),
        F.coalesce((n / (bw * bh) < 0.20) & (F.least(bw, bh) >= 6), F.lit(False)).alias("thin"))


# --- valleys

def valleys(projection: DataFrame, most: float = 0.58, margin: float = 0.15) -> DataFrame:
    """(glyph_id, x, score) where a wide box may be cut: columns of least ink, smoothed, between its margins, against the higher of the peaks on both sides.

    projection: (glyph_id, x, n, width) with a row for each column, x from 0."""
    order = _picture().orderBy("x")
    k = F.greatest(F.lit(3), F.floor(F.col("width") / 18) * 2 + 1)
    half = F.floor(k / 2)
    # a moving sum of a width that differs between pictures is a difference of running sums; columns outside count as empty
    p = projection.withColumn("up", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = p.groupBy("glyph_id", "width").agg(F.array_sort(F.collect_list(F.struct("x", "up"))).alias("sums"))
    at = lambda i: F.when(i < 0, 0).otherwise(F.try_element_at(F.col("sums"), F.least(i, F.col("width") - 1).cast("int") + 1)["up"])
    s = F.transform("sums", lambda c: F.struct(c["x"].alias("x"), ((at(c["x"] + half) - at(c["x"] - half - 1)) / k).alias("s")))
    p = g.select("glyph_id", "width", F.inline(s))
    peak = lambda lo, hi: F.coalesce(F.max("s").over(order.rowsBetween(lo, hi)), F.lit(0.0))
    w = p.withColumns({"before": F.lag("s").over(order), "after": F.lead("s").over(order), "peak": F.greatest(peak(Window.unboundedPreceding, -1), peak(1, Window.unboundedFollowing), F.lit(1.0)), "top": F.max("s").over(_picture())})
    lo, hi = F.floor(F.col("width") * margin), F.floor(F.col("width") * (1.0 - margin))
    low = (F.col("s") <= F.col("before")) & (F.col("s") <= F.col("after")) & (F.col("x") > lo) & (F.col("x") < hi - 1)
    fits = low & (F.col("width") >= 7) & (hi - lo >= 3) & (F.col("top") > 0)
    return w.withColumn("score", F.col("s") / F.col("peak")).filter(fits & (F.col("score") <= most)).select("glyph_id", "x", "score")


def cut_at(pixels: DataFrame, ink: Column, cuts: DataFrame, least: int = 4) -> DataFrame:
    """(glyph_id, segment, x, y, w, h): the ink boxes of the pieces between ``cuts`` (glyph_id, x), of pictures with two such pieces or more.

    Pieces narrower than ``least`` are left out; a box is two pixels wide and high at least."""
    size = pixels.groupBy("glyph_id").agg((F.max("x") + 1).alias("end"))
    marks = size.join(cuts.groupBy("glyph_id").agg(F.collect_set("x").alias("xs")), "glyph_id", "left")
    marks = marks.select("glyph_id", F.array_sort(F.array_append(F.coalesce("xs", F.array().cast(T.ArrayType(cuts.schema["x"].dataType))), F.col("end"))).alias("xs"))
    seg = marks.select("glyph_id", "xs", F.posexplode("xs").alias("k", "x1")).withColumn("x0", F.coalesce(F.get("xs", F.col("k") - 1), F.lit(0))).drop("xs", "k").filter(F.col("x1") - F.col("x0") >= least)
    own = pixels.filter(ink).select("glyph_id", "y", "x").join(seg, "glyph_id").filter("x >= x0 and x < x1")
    box = own.groupBy("glyph_id", F.col("x0").alias("segment")).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.greatest(F.lit(2), F.max("x") - F.min("x") + 1).alias("w"), F.greatest(F.lit(2), F.max("y") - F.min("y") + 1).alias("h"))
    return box.withColumn("k", F.count("*").over(_picture())).filter("k >= 2").drop("k")


def cut_evenly(pixels: DataFrame, ink: Column, counts: DataFrame) -> DataFrame:
    """``cut_at`` equal widths: counts (glyph_id, n) says into how many pieces; the last one takes the rest."""
    size = pixels.groupBy("glyph_id").agg((F.max("x") + 1).alias("width"))
    width = F.floor(F.col("width") / F.col("n"))
    cuts = size.join(counts, "glyph_id").filter((F.col("n") >= 2) & (width >= 4)).select("glyph_id", F.explode(F.transform(F.sequence(F.lit(1), F.col("n").cast("int") - 1), lambda k: k * width)).alias("x"))
    return cut_at(pixels, ink, cuts)


def split_wide(pixels: DataFrame, ink: Column, counts: DataFrame) -> DataFrame:
    """Pictures of ``counts`` (glyph_id, n) cut into n characters: at their deepest valleys where there are enough, else evenly."""
    wide = counts.filter("n >= 2")
    size = pixels.groupBy("glyph_id").agg((F.max("x") + 1).alias("width"))
    grid = size.select("glyph_id", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)).alias("x"))
    projection = grid.join(pixels.groupBy("glyph_id", "x").agg(F.count_if(ink).alias("n")), ["glyph_id", "x"])
    deep = valleys(projection).join(wide, "glyph_id").withColumn("k", F.row_number().over(_picture().orderBy("score", "x"))).filter("k < n")
    enough = deep.groupBy("glyph_id").agg(F.count("*").alias("found"), F.first("n").alias("n")).filter("found >= n - 1").select("glyph_id")
    by_valley = cut_at(pixels, ink, deep.join(enough, "glyph_id", "left_semi"))
    rest = wide.join(by_valley, "glyph_id", "left_anti")
    return by_valley.withColumn("how", F.lit("valley")).unionByName(cut_evenly(pixels, ink, rest).withColumn("how", F.lit("even")))


def row_band(pixels: DataFrame, ink: Column, ratio: float = 0.25) -> DataFrame:
    """(glyph_id, y0, y1): the rows from the first to the last that hold a good part of the fullest row's ink, and at least 5 pixels."""
    rows_ = pixels.groupBy("glyph_id", "y").agg(F.count_if(ink).alias("n"))
    full = rows_.withColumn("peak", F.max("n").over(_picture())).filter(F.col("n") >= F.greatest(F.lit(5.0), F.col("peak") * ratio))
    return full.groupBy("glyph_id").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"))
