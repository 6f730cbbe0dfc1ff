"""Halves of digits pasted together: the measures of two neighbouring glyphs as one picture.

Which glyphs are neighbours in a line is known only once small ones have gone, so all pairs are measured that may become halves of one
digit: near, level with each other and narrow together, by bounds that the tests of a line can only tighten. Pairs meet in strips of
an image as wide as two halves may be, and their pictures join them afterwards. A glyph's picture is a row of bytes; a pair's is an array inside its task.

Defined results: a glyph without a picture is in no pair; one without ink counts as its whole picture; where halves overlap, ink of either counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pixels as P
from . import refinement as R

# Bounds on two halves in pixels and by the height of a line: of a half's height, the gap, both widths, their ratio; least overlap of the lower one.
HEIGHT, GAP, WIDTH, RATIO, OVERLAP = (84.0, 0.92), (8.0, 0.18), (60.0, 0.72), 1.15, 0.32


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pixels (image_id, place, y, x, i) of one picture that follow one another, as one row: places and ink as bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k) for k in ("image_id", "place")]
        same = [pc.fill_null(pc.equal(k.slice(1), k.slice(0, len(k) - 1)), False).to_numpy(zero_copy_only=False) for k in keys]
        a = np.concatenate(([0], np.flatnonzero(~(same[0] & same[1])) + 1))
        whole = np.stack([batch.column(c).to_numpy().astype(np.int32) for c in ("y", "x", "i")], 1)
        rows = [r.tobytes() for r in np.split(whole, a[1:])]
        yield pa.RecordBatch.from_arrays([*[k.take(pa.array(a)) for k in keys], pa.array(rows, pa.binary())], ["image_id", "place", "dots"])


def _cropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ink box of each picture, of all its packed rows."""
    for batch in batches:
        dots, wide = [], []
        for parts in batch.column("dots").to_pylist():
            y, x, i = np.frombuffer(b"".join(parts), np.int32).reshape(-1, 3).T
            ink = np.flatnonzero(i)
            if not len(ink):
                w, crop = int(x.max() - x.min()) + 1, np.zeros((int(x.max() - x.min()) + 1) * (int(y.max() - y.min()) + 1), np.uint8)
            else:
                y, x = y[ink], x[ink]
                y, x = y - y.min(), x - x.min()
                w = int(x.max()) + 1
                crop = np.zeros((int(y.max()) + 1) * w, np.uint8)
                crop[y * w + x] = 1
            dots.append(crop.tobytes())
            wide.append(w)
        yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("place"), pa.array(dots, pa.binary()), pa.array(wide, pa.int32())], ["image_id", "place", "dots", "wide"])


def crops(pictures: DataFrame) -> DataFrame:
    """(image_id, place, dots, wide): the ink box of each glyph's picture (image_id, place, y, x, v), a byte of 0 or 1 for each dot, line by line.

    Pixels are packed where they are, so a picture is one row, or few, before it travels; a pixel that is missing is ground."""
    ink = F.coalesce(F.col("v") > 0, F.lit(False)).cast("int").alias("i")
    key = [T.StructField(k, pictures.schema[k].dataType) for k in ("image_id", "place")]
    packed = pictures.select("image_id", "place", "y", "x", ink).filter("image_id is not null and place is not null and y is not null and x is not null").mapInArrow(_packed, T.StructType([*key, T.StructField("dots", T.BinaryType())]))
    whole = packed.groupBy("image_id", "place").agg(F.collect_list("dots").alias("dots"))
    return whole.mapInArrow(_cropped, T.StructType([*key, T.StructField("dots", T.BinaryType()), T.StructField("wide", T.IntegerType())]))


def pairs(glyphs: DataFrame) -> DataFrame:
    """(image_id, left, right, ax, ay, aw, ah, bx, by, bw, bh): glyphs (image_id, place, x, y, w, h) that may be halves of one digit."""
    most = lambda c: F.greatest(F.lit(c[0]), F.col("top") * c[1])
    g = glyphs.withColumn("top", F.max("h").over(Window.partitionBy("image_id"))).filter(F.col("h") <= most(HEIGHT)).withColumn("strip", F.floor(F.col("x") / most(WIDTH)))
    named = lambda p, place: [F.col("place").alias(place), *[F.col(c).alias(p + c) for c in "xywh"]]
    a = g.select("image_id", "top", *named("a", "left"), F.explode(F.array("strip", F.col("strip") + 1)).alias("strip"))
    b = g.select("image_id", "strip", *named("b", "right"))
    c = F.col
    gap, over = c("bx") - (c("ax") + c("aw")), F.least(c("ay") + c("ah"), c("by") + c("bh")) - F.greatest("ay", "by")
    wide, high = F.greatest(c("ax") + c("aw"), c("bx") + c("bw")) - c("ax"), F.greatest(c("ay") + c("ah"), c("by") + c("bh")) - F.least("ay", "by")
    fits = (c("ax") <= c("bx")) & (c("left") != c("right")) & (gap <= most(GAP)) & (F.greatest(F.lit(0), over) >= F.least("ah", "bh") * OVERLAP) & (wide <= most(WIDTH)) & (wide / F.greatest(F.lit(1), high) <= RATIO)
    return a.join(b, ["image_id", "strip"]).filter(fits).drop("strip", "top")


#: Pixels of pasted pictures that a task holds at a time, or those of one.
HELD = 2_000_000


def _pasted(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, dots: list[list[bytes]], wide: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Pictures of ``size`` (height, width) with the ink of both crops in their boxes, stretched to them by their nearest pixels.

    All but size and dots have a line for the left crop and one for the right; places are counted from the picture's corner."""
    out = np.zeros((x.shape[1], *size), bool)
    for k, own in enumerate(dots):
        n = np.array([len(d) for d in own])
        flat = np.concatenate([np.zeros(1, bool), *[np.frombuffer(d, bool) for d in own]])
        first = 1 + np.cumsum(n) - n

        def source(at: np.ndarray, length: np.ndarray, of: np.ndarray) -> np.ndarray:
            """Where in a crop each place comes from; far below 0 outside its box."""
            near = np.minimum(of[:, None] - 1, np.floor(at * (1.0 / (length / of))[:, None]).astype(np.int64))
            return np.where((at >= 0) & (at < length[:, None]), near, -(1 << 40))

        high = n // wide[k]
        rows = source(np.arange(size[0]) - y[k][:, None], h[k], high) * wide[k][:, None] + first[:, None]
        columns = source(np.arange(size[1]) - x[k][:, None], w[k], wide[k])
        out |= np.take(flat, rows[:, :, None] + columns[:, None, :], mode="clip")
    return out


def _shares(ink: np.ndarray, w: np.ndarray, h: np.ndarray) -> dict[str, np.ndarray]:
    """``pixels.glyph_features`` of pictures w wide and h high but for their holes, by running sums over rows and columns."""
    sums = np.zeros((len(ink), ink.shape[1] + 1, ink.shape[2] + 1), np.int32)
    np.cumsum(np.cumsum(ink, 1, dtype=np.int32), 2, out=sums[:, 1:, 1:])
    rows, columns = ink.any(2), ink.any(1)
    some, each = rows.any(1), np.arange(len(ink))
    first = lambda of: np.where(some, of.argmax(1), 0)
    last = lambda of, whole: np.where(some, of.shape[1] - of[:, ::-1].argmax(1), whole)
    x0, y0 = first(columns), first(rows)
    cw, ch = last(columns, w) - x0, last(rows, h) - y0

    def share(x: np.ndarray, x_end: np.ndarray, y: np.ndarray, y_end: np.ndarray) -> np.ndarray:
        (x, x_end), (y, y_end) = ((np.maximum(a, 0), np.minimum(b, n)) for a, b, n in ((x, x_end, cw), (y, y_end, ch)))
        at = lambda y, x: sums[each, y0 + y, x0 + x]
        area = np.maximum(x_end - x, 0) * np.maximum(y_end - y, 0)
        x_end, y_end = np.maximum(x_end, x), np.maximum(y_end, y)
        return np.divide(at(y_end, x_end) - at(y, x_end) - at(y_end, x) + at(y, x), area, out=np.zeros(len(ink)), where=area > 0)

    part = lambda n, d: np.maximum(1, n // d)
    u, v, s, t, none = part(cw, 2), part(ch, 2), part(cw, 3), part(ch, 3), np.zeros_like(cw)
    return {
        "content_w": cw, "content_h": ch, "aspect": cw / ch, "fill": share(none, cw, none, ch), "left": share(none, u, none, ch), "right": share(cw - u, cw, none, ch), "top": share(none, cw, none, v), "bottom": share(none, cw, ch - v, ch),
        "center": share(s, cw - s, t, ch - t), "center_row": share(none, cw, ch // 2 - 1, ch // 2 + 2), "center_col": share(cw // 2 - 1, cw // 2 + 2, none, ch),
        "diag_primary": share(none, u, none, v) + share(cw - u, cw, ch - v, ch), "diag_secondary": share(cw - u, cw, none, v) + share(none, u, ch - v, ch)}


def _holes(ink: np.ndarray, w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How many parts of each picture's ground, corners apart, lie off its frame; the parts of all are found at once."""
    n, high, width = ink.shape
    ground = np.zeros((n, high, width + 1), bool)  # no run goes on in the next row
    ground[:, :, :-1] = ~ink & (np.arange(high) < h[:, None])[:, :, None] & (np.arange(width) < w[:, None])[:, None, :]
    flat = np.concatenate(([False], ground.ravel()))
    ends = np.flatnonzero(flat[1:] != flat[:-1])
    start, end = ends[::2], ends[1::2] - 1
    if not len(start):
        return np.zeros(n, np.int64)
    row, x0 = np.divmod(start, width + 1)
    of, y = np.divmod(row, high)
    x1 = x0 + end - start
    part = P.hanging_together(row + of, x0, x1, 0)  # a row between pictures
    shut = part == np.arange(len(part))
    shut[part[(y == 0) | (y == h[of] - 1) | (x0 == 0) | (x1 == w[of] - 1)]] = False
    return np.bincount(of[shut], minlength=n)


def _pieces(w: np.ndarray, h: np.ndarray) -> Iterator[slice]:
    """Pictures that fit into ``HELD`` pixels when all are as large as the largest, or one that does not."""
    lo = 0
    while lo < len(w):
        n = np.arange(1, len(w) - lo + 1)
        fits = n * np.maximum.accumulate(w[lo:]) * np.maximum.accumulate(h[lo:]) <= HELD
        hi = lo + max(1, int(fits.sum()))
        yield slice(lo, hi)
        lo = hi


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pairs with both crops to their measures."""
    keys = ["image_id", "left", "right"]
    for batch in batches:
        x, y, w, h = (np.stack([batch.column(p + c).to_numpy().astype(np.int64) for p in "ab"]) for c in "xywh")
        wide = np.stack([batch.column(p + "_wide").to_numpy().astype(np.int64) for p in "ab"])
        x, y = x - x.min(0), y - y.min(0)
        width, high = (x + w).max(0), (y + h).max(0)
        for at in _pieces(width, high):
            own, (cw, ch) = batch.slice(at.start, at.stop - at.start), (width[at], high[at])
            ink = _pasted(*[c[:, at] for c in (x, y, w, h)], [own.column(p + "_dots").to_pylist() for p in "ab"], wide[:, at], (int(ch.max()), int(cw.max())))
            found = _shares(ink, cw, ch) | {"holes": _holes(ink, cw, ch)}
            f = pa.StructArray.from_arrays([pa.array(found[m].astype(np.float64)) for m in R.MEASURES], list(R.MEASURES))
            yield pa.RecordBatch.from_arrays([*[own.column(k) for k in keys], f], [*keys, "f"])


def together(glyphs: DataFrame, pictures: DataFrame) -> DataFrame:
    """(image_id, left, right, f): the measures of all pairs that may be halves, for ``refine_images``.

    glyphs: (image_id, place, x, y, w, h), boxes at least a pixel wide and high; pictures: (image_id, place, y, x, v), ink where v > 0.
    A pair's picture is made and measured in the task that has the pair: no row for a pixel."""
    crop = crops(pictures)
    side = lambda p, at: crop.withColumnsRenamed({"place": at, "dots": f"{p}_dots", "wide": f"{p}_wide"})
    both = pairs(glyphs).join(side("a", "left"), ["image_id", "left"]).join(side("b", "right"), ["image_id", "right"])
    measures = T.StructType([T.StructField(m, T.DoubleType()) for m in R.MEASURES])
    return both.mapInArrow(_measured, T.StructType([*[T.StructField(k, both.schema[k].dataType) for k in ("image_id", "left", "right")], T.StructField("f", measures)]))


def refine_pictures(glyphs: DataFrame, pictures: DataFrame) -> DataFrame:
    """``refine_images`` of glyphs (image_id, item), with halves measured on their own pictures (image_id, place, y, x, v)."""
    boxes = glyphs.select("image_id", *[F.col(f"item.{c}").alias(c) for c in ("place", "x", "y", "w", "h")])
    return R.refine_images(glyphs, together(boxes, pictures))
