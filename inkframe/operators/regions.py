"""Boxes of what hangs together on a page, with those that a line has grown together, and regions that may hold an expression.

Pictures are pixel rows (image_id, y, x, ...) of any sizes, with a row for each pixel. Work goes by picture and row of runs; only the fold
that gives each box its place among those kept, and the one that merges regions, look at a picture's boxes at once.

Defined results: a null or absent mark counts as no ink; a picture without boxes proposes itself whole; a picture of less than
nine rows has no bands; no rows give no rows. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import Box
from ..sources.staged import staged, tasks_of
from . import boxes as B
from . import masks, splitting
from . import pixels as P

# Fixed values of boxes: least area inside the outline (pixels, share of the picture), least width and height, share of a side from which on a box is the page's frame.
PART, LEAST, FRAME = (6.0, 0.000015), (2, 4), 0.98
# Fixed values of blobs on a line: least width and height (pixels, share), least aspect and width; width from which on a line is long, its span then and else, gap, height.
BLOB, BLOB_ASPECT, LONG = {"w": (72, 0.30), "h": (22, 0.06)}, (1.35, 28), 120
LINE = {"span": (0.42, 0.36), "gap": 0.10, "height": 0.18}
# Fixed values of what is found in a blob: specks, least area and height (pixels, share), least fill, shares of the blob from which on it is the blob itself.
FOUND = {"specks": (6, 0.00035), "area": (18, 0.00012), "h": (14, 0.28), "fill": 0.08, "whole": (0.92, 0.65)}
# Fixed values of characters among boxes: least area and height (pixels, share), most height and width (shares), aspect and share of the median height of dashes, margin, least area at the margin.
CHARACTER = {"area": (8, 0.00002), "h": (8, 0.018), "most": (0.80, 0.75), "dash": (12.0, 0.7), "margin": (6, 0.02), "border": (12.0, 0.35)}
# Fixed values of regions: step to a new row (pixels, medians), pads of rows and of all (pixels, medians), least width and height (pixels, shares).
ROW, ROW_PAD, COMPACT, REGION = (16, 0.85), (12, 0.9), ((14, 1.15), (14, 1.10)), ((28, 0.08), (24, 0.05))
# Fixed values of bands: least kernel, rows of the page a step of it, spreads above the mean, share of the peak, least height (rows, share), pad.
BAND = {"kernel": 9, "step": 40, "spreads": 0.35, "peak": 0.22, "h": (20, 0.04), "pad": 10}


def _least(pair: tuple[float, float], of: Column | str) -> Column:
    """The larger of a number of pixels and the whole part of a share."""
    return F.greatest(F.lit(pair[0]), F.floor((F.col(of) if isinstance(of, str) else of) * pair[1]))


def _marked(pixels: DataFrame, ink: Column) -> DataFrame:
    return pixels.select("image_id", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.coalesce(ink, F.lit(False)).alias("i"))


def _runs(marked: DataFrame) -> DataFrame:
    """(image_id, y, x0, x1, i): the runs of ink and of ground in pictures (image_id, y, x, i), by one look at the pixels."""
    places = lambda test: F.sort_array(F.collect_list(F.when(test, F.col("x"))))
    rows = marked.groupBy("image_id", "y").agg(places(F.col("i")).alias("ink"), places(~F.col("i")).alias("ground"))
    own = lambda c, i: F.transform(P.runs_in(c), lambda r: F.struct(r["x0"].alias("x0"), r["x1"].alias("x1"), F.lit(i).alias("i")))
    return staged(rows.select("image_id", "y", F.inline(F.concat(own("ink", True), own("ground", False)))), "runs")


def _frames(runs: DataFrame) -> DataFrame:
    return runs.groupBy("image_id").agg((F.max("x1") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def _inside(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """(glyph_id, y, x0, x1, mx, my): the parts of ``runs`` in each box (glyph_id, image_id, x, y, w, h), counted from its corner; mx and my are its last column and row."""
    b = boxes.select("glyph_id", "image_id", *[F.col(c).alias(f"b{c}") for c in "xywh"])
    met = runs.join(b, "image_id").filter("y >= by and y < by + bh and x1 >= bx and x0 < bx + bw")
    ends = {"y": F.col("y") - F.col("by"), "x0": F.greatest("x0", "bx") - F.col("bx"), "x1": F.least(F.col("x1"), F.col("bx") + F.col("bw") - 1) - F.col("bx"), "mx": F.col("bw") - 1, "my": F.col("bh") - 1}
    return met.select("glyph_id", *[v.cast("int").alias(k) for k, v in ends.items()])


def outlines(marked: DataFrame) -> DataFrame:
    """(image_id, part, x, y, w, h, area): the outermost outlines of ink in pictures (image_id, y, x, i), corners join.

    What an outline shuts in belongs to it, so ink within a hole has none of its own. The area is that of the polygon through the outline's pixels: each two
    runs that overlap in neighbouring rows add the squares between them, and half a square at each end that only one of them goes beyond."""
    return _outlines(_runs(marked))


def _met(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs in the order of rows and places, the pairs that overlap in neighbouring rows."""
    wide = int(x1.max()) + 2
    start, end = y.astype(np.int64) * wide + x0, y.astype(np.int64) * wide + x1
    first, after = np.searchsorted(end, start + wide), np.searchsorted(start, end + wide, side="right")
    count = np.maximum(after - first, 0)
    u = np.repeat(np.arange(len(y)), count)
    return u, np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(u))


def _ends(at: np.ndarray, n: int, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, ...]:
    """Left, right, top and lower end of ``n`` parts, of runs that belong to the parts ``at``."""
    low, high = lambda of: np.full(n, of.max()), lambda of: np.full(n, of.min())
    found = (np.minimum, low(x0), x0), (np.maximum, high(x1), x1), (np.minimum, low(y), y), (np.maximum, high(y), y)
    for f, out, of in found:
        f.at(out, at, of)
    return tuple(out for _, out, _ in found)


def _outlined(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, ink: np.ndarray) -> tuple[np.ndarray, ...]:
    """(part, x, y, w, h, area) of a picture's outlines, of its runs of ink and ground in the order of rows and places."""
    kept, right, low = ink.copy(), x1.max(), y.max()
    ground = np.flatnonzero(~ink)
    if len(ground):
        at = P.hanging_together(y[ground], x0[ground], x1[ground], 0)
        a, b, c, d = _ends(at, len(ground), y[ground], x0[ground], x1[ground])
        kept[ground] = ((a > 0) & (b < right) & (c > 0) & (d < low))[at]
    y, x0, x1 = y[kept], x0[kept], x1[kept]
    if not len(y):
        return (y,) * 6
    fresh = np.concatenate(([True], (y[1:] != y[:-1]) | (x0[1:] > x1[:-1] + 1)))
    last = np.concatenate((fresh[1:], [True]))
    y, x0, x1 = y[fresh], x0[fresh], x1[last]
    part, at = np.unique(P.hanging_together(y, x0, x1, 1), return_inverse=True)
    a, b, c, d = _ends(at, len(part), y, x0, x1)
    u, v = _met(y, x0, x1)
    square = np.minimum(x1[u], x1[v]) - np.maximum(x0[u], x0[v]) + (x0[u] != x0[v]) / 2 + (x1[u] != x1[v]) / 2
    return part, a, c, b - a + 1, d - c + 1, np.bincount(at[u], square, len(part))


def _outlines(of: DataFrame) -> DataFrame:
    """The same of ``_runs``: dealt by picture to as many tasks as the runs need, a picture's runs in one row, so that they are shuffled once."""
    own = of.repartition(tasks_of(of), "image_id").groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")], "i"))).alias("r"))
    names = ["part", *"xywh", "area"]

    def outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.column("r")[k].values
                found = _outlined(*[r.field(c).to_numpy(zero_copy_only=False) for c in ("y", "x0", "x1", "i")])
                columns = [pa.array(c.astype(np.int64 if n != "area" else float)) for n, c in zip(names, found)]
                yield pa.RecordBatch.from_arrays([b.column("image_id").take(pa.array(np.full(len(columns[0]), k))), *columns], ["image_id", *names])

    return own.mapInArrow(outlined, T.StructType([of.schema["image_id"], *[T.StructField(c, T.LongType()) for c in names[:-1]], T.StructField("area", T.DoubleType())]))


def _components(found: DataFrame, frames: DataFrame) -> DataFrame:
    large = F.col("area") >= F.greatest(F.lit(PART[0]), (F.col("height") * F.col("width")).cast("double") * PART[1])
    framed = (F.col("w") >= F.col("width") * FRAME) | (F.col("h") >= F.col("height") * FRAME)
    kept = found.join(frames, "image_id").filter(large & ~framed & (F.col("w") >= LEAST[0]) & (F.col("h") >= LEAST[1]))
    return kept.select("image_id", F.col("part").alias("glyph_id"), *"xywh")


def components(pixels: DataFrame, ink: Column) -> DataFrame:
    """(image_id, glyph_id, x, y, w, h): boxes of outlines of some area that are not the page's frame."""
    runs = _runs(_marked(pixels, ink))
    return _components(_outlines(runs), _frames(runs))


def _closed(a: np.ndarray) -> np.ndarray:
    """Closing under a pixel, the one above and the one before it."""
    grown = a.copy()
    grown[:, 1:] |= a[:, :-1]
    grown[1:] |= a[:-1]
    out = grown.copy()
    out[:, 1:] &= grown[:, :-1]
    out[1:] &= grown[:-1]
    return out


def _healed(runs: DataFrame) -> DataFrame:
    """(glyph_id, y, x0, x1) of pictures (glyph_id, y, x0, x1, mx, my), closed."""
    places = ["y", "x0", "x1"]
    own = runs.groupBy("glyph_id").agg(F.first("mx").alias("mx"), F.first("my").alias("my"), F.collect_list(F.struct(*places)).alias("r"))

    def healed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                a = _closed(splitting.drawn(b.column("r")[i].values, b.column("mx")[i].as_py() + 1, b.column("my")[i].as_py() + 1))
                turns = np.diff(a.astype(np.int8), axis=1, prepend=0, append=0)
                (y, x0), x1 = np.nonzero(turns == 1), np.nonzero(turns == -1)[1] - 1
                yield pa.RecordBatch.from_arrays([b.column("glyph_id").take(pa.array([i] * len(y), pa.int64())), *[pa.array(c.astype(np.int32)) for c in (y, x0, x1)]], ["glyph_id", *places])

    return own.mapInArrow(healed, T.StructType([runs.schema["glyph_id"], *[T.StructField(c, T.IntegerType()) for c in places]]))


def _with_ground(ink: DataFrame) -> DataFrame:
    """``_runs`` of pictures' runs of ink (image_id, y, x0, x1, width, height)."""
    own = ink.withColumnRenamed("image_id", "glyph_id")
    rows = own.select("glyph_id", "width", "height").distinct().select("glyph_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"), F.lit(0).alias("x0"), (F.col("width") - 1).alias("x1"))
    ground = masks.without(rows, own)
    return own.select(*rows.columns, F.lit(True).alias("i")).unionByName(ground.withColumn("i", F.lit(False))).withColumnRenamed("glyph_id", "image_id")


def _blobs(runs: DataFrame, found: DataFrame, frames: DataFrame) -> DataFrame:
    """All by runs; the only pictures that are drawn are a blob's while it is healed and while its boxes are cut, in their tasks."""
    big = found.join(frames, "image_id").filter((F.col("w") >= _least(BLOB["w"], "width")) & (F.col("h") >= _least(BLOB["h"], "height")) & (F.col("w") >= F.greatest(F.col("h") * BLOB_ASPECT[0], F.lit(float(BLOB_ASPECT[1])))))
    named = staged(big.select(F.struct("image_id", "part").alias("glyph_id"), "image_id", *"xywh"), "blobs")
    own = staged(_inside(runs.filter("i"), named), "blob_runs", by="glyph_id")
    span = F.when(F.col("mx") + 1 >= LONG, LINE["span"][0]).otherwise(LINE["span"][1])
    lines = staged(masks.ruled_lines(own, lower=True, span=span, gap=LINE["gap"], height=LINE["height"]), "lines", by="glyph_id")
    rest = masks.without(own.join(lines.select("glyph_id").distinct(), "glyph_id", "left_semi"), lines)
    parts = staged(P.labelled_runs(_healed(rest)), "parts", by="glyph_id")
    size = named.select("glyph_id", F.col("w").cast("int").alias("width"), F.col("h").cast("int").alias("height"))
    areas = parts.groupBy("glyph_id", "part").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area")).join(size, "glyph_id")
    large = P.without_specks(areas, _least(FOUND["specks"], F.col("width") * F.col("height"))).drop("area")
    clean = staged(parts.join(large, ["glyph_id", "part"]).drop("part").withColumnRenamed("glyph_id", "image_id"), "rest", by="image_id")
    frame = clean.select("image_id", "width", "height").distinct()
    pictures = clean.groupBy("image_id").agg(F.collect_list(F.struct("y", "x0", "x1")).alias("r"), F.first("width").alias("width"), F.first("height").alias("height"))
    split = splitting.split_pictures(pictures, _components(_outlines(staged(_with_ground(clean), "blob_ground")), frame))
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("glyph_id", "path", "x", "y")).cast("long")
    pieces = staged(split.select("image_id", number.alias("number"), *"xywh"), "found", by="image_id")
    inked = _inside(clean, pieces.withColumnRenamed("number", "glyph_id").select(F.struct("image_id", "glyph_id").alias("glyph_id"), "image_id", *"xywh"))
    inked = inked.groupBy("glyph_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n")).select("glyph_id.image_id", F.col("glyph_id.glyph_id").alias("number"), "n")
    fill = F.coalesce("n", F.lit(0)) / F.greatest(F.lit(1), F.col("w") * F.col("h"))
    d = pieces.join(inked, ["image_id", "number"], "left").withColumn("fill", fill)
    d = d.select("*", F.col("image_id.part").alias("part")).join(named.select(F.col("glyph_id").alias("image_id"), *[F.col(c).alias(f"b{c}") for c in "xywh"]), "image_id")
    whole = (F.col("w") >= F.col("bw") * FOUND["whole"][0]) & (F.col("h") >= F.col("bh") * FOUND["whole"][1])
    kept = d.filter((F.col("w") * F.col("h") >= _least(FOUND["area"], F.col("bw") * F.col("bh"))) & (F.col("h") >= _least(FOUND["h"], "bh")) & (F.col("fill") >= FOUND["fill"]) & ~whole)
    moved = kept.select(F.col("image_id.image_id").alias("image_id"), "part", "number", (F.col("bx") + F.col("x")).alias("x"), (F.col("by") + F.col("y")).alias("y"), "w", "h")
    # numbers below those of parts, which count from 0: told apart, and in the order of blobs and pieces
    back = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("part"), F.desc("number"))).cast("long")
    return moved.select("image_id", (-back).alias("glyph_id"), *"xywh")


def blobs_on_lines(pixels: DataFrame, ink: Column) -> DataFrame:
    """(image_id, glyph_id, x, y, w, h): what wide blobs hold when the line in their lower part is taken away, wide boxes split.

    A blob without a line among its runs gives nothing: slanted lines are not looked for."""
    runs = _runs(_marked(pixels, ink))
    return _blobs(runs, staged(_outlines(runs), "found"), _frames(runs))


def _recovered(runs: DataFrame) -> DataFrame:
    found, frames = staged(_outlines(runs), "found"), staged(_frames(runs), "frames")
    return B.added_clear(_components(found, frames), _blobs(runs, found, frames))


def components_with_blobs(pixels: DataFrame, ink: Column) -> DataFrame:
    """``components``, and those of ``blobs_on_lines`` that overlap none kept so far, from left to right."""
    return _recovered(_runs(_marked(pixels, ink)))


def density_bands(marked: DataFrame) -> DataFrame:
    """(image_id, k, y0, y1, height): stretches of rows whose smoothed ink is dense for their picture (image_id, y, x, i), y1 the row after them.

    Rows outside a picture count as empty. Sums are whole numbers up to the last step, so reruns agree. A stretch that ends before the picture does must be of some height."""
    return _bands(marked.groupBy("image_id", "y").agg(F.count_if("i").alias("n")))


def _bands(inked: DataFrame) -> DataFrame:
    """The same of rows (image_id, y, n) with their ink."""
    order = Window.partitionBy("image_id").orderBy("y")
    rows = inked.withColumn("up", F.sum("n").over(order))
    g = rows.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "up"))), lambda p: p["up"]).alias("ups")).withColumn("height", F.size("ups"))
    g = g.filter(F.col("height") >= BAND["kernel"]).withColumn("kernel", F.greatest(F.lit(BAND["kernel"]), F.floor(F.col("height") / BAND["step"]).cast("int") * 2 + 1))
    half = F.floor(F.col("kernel") / 2).cast("int")
    at = lambda i: F.when(i < 0, F.lit(0).cast("long")).otherwise(F.get("ups", F.least(i, F.col("height") - 1)))
    g = g.withColumn("sums", F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda i: at(i + half) - at(i - half - 1)))
    total = lambda f: F.aggregate("sums", F.lit(0).cast("long"), lambda a, s: a + f(s))
    g = g.withColumns({"s1": total(lambda s: s), "s2": total(lambda s: s * s), "peak": F.array_max("sums")})
    h = F.col("height")
    cutoff = F.greatest((F.col("s1") + F.sqrt((h * F.col("s2") - F.col("s1") * F.col("s1")).cast("double")) * BAND["spreads"]) / h, F.col("peak") * BAND["peak"])
    dense = g.withColumn("cutoff", cutoff).select("image_id", "height", "cutoff", F.posexplode("sums").alias("y", "s")).filter("s >= cutoff")
    isle = dense.withColumn("isle", F.col("y") - F.row_number().over(order))
    found = isle.groupBy("image_id", "isle").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.first("height").alias("height"))
    some = found.filter((F.col("y1") == h) | (F.col("y1") - F.col("y0") >= _least(BAND["h"], "height")))
    return some.select("image_id", F.row_number().over(Window.partitionBy("image_id").orderBy("y0")).alias("k"), "y0", "y1", "height")


def proposals(runs: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, ord, x0, y0, x1, y1): regions of pictures, given as ``_runs``, that may hold an expression, each once, in this order: around all
    characters among ``boxes`` (image_id, glyph_id, x, y, w, h), around each row of them, dense bands, rows and bands that are near joined, the whole picture."""
    frames = staged(_frames(runs), "frames")
    c, b, over = CHARACTER, Box(), Window.partitionBy("image_id")
    d = boxes.join(frames, "image_id").withColumns({"mw": F.median("w").over(over), "mh": F.median("h").over(over)})
    width, height, area = F.col("width"), F.col("height"), F.col("w") * F.col("h")
    dash = (F.col("w") / F.greatest(F.lit(1), F.col("h")) > c["dash"][0]) & (F.col("h") < F.col("mh") * c["dash"][1])
    charish = (area >= _least(c["area"], height * width)) & (F.col("h") >= _least(c["h"], height)) & ~((F.col("h") > height * c["most"][0]) | (F.col("w") > width * c["most"][1])) & ~dash
    d = d.withColumn("charish", charish).withColumn("base", F.col("charish") | (F.count_if("charish").over(over) < 2))
    mx, my = _least(c["margin"], width), _least(c["margin"], height)
    border = (b.x <= mx) | (b.y <= my) | (b.right >= width - mx) | (b.bottom >= height - my)
    d = d.withColumn("ma", F.median(F.when(F.col("base"), area)).over(over))
    d = d.withColumn("core", F.col("base") & ~(border & (area < F.greatest(F.lit(c["border"][0]), F.col("ma") * c["border"][1]))))
    source = d.withColumn("n_core", F.count_if("core").over(over)).filter(F.col("core") | (F.col("base") & (F.col("n_core") < 2)))
    order = over.orderBy("cy", "glyph_id")
    step = F.col("cy") - F.lag("cy").over(order) > _least(ROW, "mh")
    rowed = source.withColumn("cy", b.center_y).withColumn("new", F.coalesce(step.cast("int"), F.lit(0))).withColumn("line", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rowed = staged(rowed.select("image_id", "line", *"xywh", "mw", "mh", "width", "height"), "rowed")

    def around(by: list[str], pad_x: tuple[float, float], pad_y: tuple[float, float]) -> DataFrame:
        px, py = _least(pad_x, F.first("mw")), _least(pad_y, F.first("mh"))
        return rowed.groupBy("image_id", *by).agg(
            F.greatest(F.lit(0), F.min("x") - px).alias("x0"), F.greatest(F.lit(0), F.min("y") - py).alias("y0"),
            F.least(F.first("width"), F.max(b.right) + px).alias("x1"), F.least(F.first("height"), F.max(b.bottom) + py).alias("y1"), F.first("width").alias("width"), F.first("height").alias("height"))

    def kind(d: DataFrame, k: int, n: Column | str = "k") -> DataFrame:
        return d.select("image_id", F.struct(F.lit(k).alias("kind"), (F.col(n) if isinstance(n, str) else n).cast("long").alias("n")).alias("ord"), *[F.col(p).cast("int").alias(p) for p in ("x0", "y0", "x1", "y1")])

    rows = around(["line"], ROW_PAD, ROW_PAD).filter((F.col("x1") - F.col("x0") >= _least(REGION[0], width)) & (F.col("y1") - F.col("y0") >= _least(REGION[1], height)))
    sizes = rowed.groupBy("image_id").agg(F.first("mh").alias("mh"), F.first("width").alias("width"))
    inked = runs.groupBy("image_id", "y").agg(F.sum(F.when(F.col("i"), F.col("x1") - F.col("x0") + 1).otherwise(0)).alias("n"))
    bands = _bands(inked).join(sizes, "image_id")
    pad = F.greatest(F.lit(BAND["pad"]), F.floor("mh"))
    bands = bands.select("image_id", "k", F.lit(0).alias("x0"), F.greatest(F.lit(0), F.col("y0") - pad).alias("y0"), F.col("width").alias("x1"), F.least(height, F.col("y1") + pad).alias("y1"))
    parts = staged(kind(rows, 1, "line").unionByName(kind(bands, 2)), "regions")
    near = B.merged_regions(B.distinct_regions(parts).join(frames, "image_id"), width, height)
    near = kind(near.withColumn("k", F.row_number().over(over.orderBy("x0", "y0", "x1", "y1"))), 3)
    whole = lambda d: kind(d.select("image_id", F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1")), 4, F.lit(0))
    found = frames.join(rowed.select("image_id").distinct(), "image_id", "left_semi")
    some = B.distinct_regions(reduce(DataFrame.unionByName, [kind(around([], *COMPACT), 0, F.lit(0)), parts, near, whole(found)]))
    none = whole(frames.join(found.select("image_id"), "image_id", "left_anti"))
    out = some.select("image_id", "ord", "x0", "y0", "x1", "y1").unionByName(none)
    return out.withColumn("ord", F.row_number().over(over.orderBy("ord")).cast("int"))


def proposed_regions(pixels: DataFrame, ink: Column) -> DataFrame:
    """``proposals`` of whole pictures by their ``components_with_blobs``."""
    runs = _runs(_marked(pixels, ink))
    return proposals(runs, staged(_recovered(runs), "recovered"))
