"""Wide boxes split into characters, again and again until none is wide.

A picture is one row: its runs of ink and its boxes, gathered by picture and dealt out. The task draws a picture that has wide boxes and cuts each box (at its deepest valleys, else
into parts that touch lightly, else evenly), then the pieces that are still wide, so that no row is made for a pixel and no round goes over the table. A piece that
is no smaller than its box is not cut again, so the sum of a box's open areas falls with each cut and the cuts end.

Defined results: an image with one box keeps it; a box that reaches out of its picture is measured by what lies inside; a box that can't
be cut stays whole. Null places take no part; an absent place within the frame is ground.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pixels as P

# Least width and height of a wide box by the medians, of a piece that is cut again, of an even cut; least width; least part (pixels, share of the box), its height.
WIDE, AGAIN, EVEN, LEAST_WIDTH, PART, PART_HEIGHT = (1.70, 0.50), (1.8, 1.1, 0.7), (1.7, 0.85), 8, (6, 0.01), (6, 0.4)
BOX = ("x", "y", "w", "h")

Piece = tuple[int, int, int, int]


def typical_sizes(boxes: DataFrame, *more: Column) -> DataFrame:
    """(image_id, n, mw, mh, more): the median of the middle half of an image's widths, and the median height."""
    g = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list("w")).alias("ws"), F.median("h").alias("mh"), F.count("*").alias("n"), *more)
    first, last = F.floor(F.col("n") / 4), F.least(F.col("n") - 1, F.floor(3 * F.col("n") / 4))
    middle = g.withColumn("some", F.slice("ws", (first + 1).cast("int"), (last - first + 1).cast("int"))).withColumn("k", F.size("some"))
    at = lambda i: F.element_at("some", F.floor(i).cast("int") + 1)
    return middle.withColumn("mw", (at((F.col("k") - 1) / 2) + at(F.col("k") / 2)) / 2.0).drop("ws", "some", "k")


def _count(w: int, mw: float, mh: float) -> int:
    """``geometry.capped_count`` of a width."""
    if mw <= 0:
        return 1
    ratio = min(w / mw, w / mh * 1.5) if mh > 0 and w / mh < 0.6 else w / mw
    return next((n for n, most in ((1, 1.55), (2, 2.45), (3, 3.45)) if ratio < most), round(ratio))


def _inked(a: np.ndarray, x: int, y: int) -> Piece | None:
    """The ink's box in a part of a picture whose corner is x, y; two pixels wide and high at least."""
    xs, ys = np.flatnonzero(a.any(0)), np.flatnonzero(a.any(1))
    return (x + int(xs[0]), y + int(ys[0]), max(2, int(xs[-1] - xs[0]) + 1), max(2, int(ys[-1] - ys[0]) + 1)) if len(xs) else None


def _between(a: np.ndarray, cuts: list[int]) -> list[Piece]:
    """``pixels.cut_at``: the pieces between the cuts, if there are two or more."""
    ends = sorted({*cuts, a.shape[1]})
    found = [_inked(a[:, p:q], p, 0) for p, q in zip([0, *ends], ends) if q - p >= 4]
    found = [f for f in found if f]
    return found if len(found) >= 2 else []


def _valleys(a: np.ndarray, most: float = 0.58, margin: float = 0.15) -> list[int]:
    """``pixels.valleys`` of a box, the deepest first."""
    w = a.shape[1]
    lo, hi = int(w * margin), int(w * (1.0 - margin))
    if w < 7 or hi - lo < 3 or not a.any():
        return []
    k = max(3, w // 18 * 2 + 1)
    up = np.concatenate(([0], np.cumsum(a.sum(0))))
    x = np.arange(w)
    s = (up[np.minimum(x + k // 2, w - 1) + 1] - up[np.maximum(x - k // 2, 0)]) / k
    peak = np.maximum(1.0, np.maximum(np.concatenate(([0.0], np.maximum.accumulate(s)[:-1])), np.concatenate((np.maximum.accumulate(s[::-1])[::-1][1:], [0.0]))))
    at = np.arange(lo + 1, hi - 1)
    at = at[(s[at] <= s[at - 1]) & (s[at] <= s[at + 1]) & (s[at] / peak[at] <= most)]
    return at[np.lexsort((at, s[at] / peak[at]))].tolist()


def _touching(a: np.ndarray, mh: float) -> list[Piece]:
    """Ink boxes of the parts that hang together only where ink is one pixel thin, if there are two or more."""
    core = a.copy()
    core[:, 1:] &= a[:, :-1]
    core[1:] &= a[:-1]
    y, x = np.nonzero(core)
    if not len(y):
        return []
    part, found = P.hanging_together(y, x, x, 1), []
    for p in np.unique(part):
        ys, xs = y[part == p], x[part == p]
        h = int(ys[-1] - ys[0]) + 1
        if len(ys) >= max(PART[0], int(a.size * PART[1])) and h >= max(PART_HEIGHT[0], int(mh * PART_HEIGHT[1])):
            x0, y0 = int(xs.min()), int(ys[0])
            found.append(_inked(a[y0 : y0 + h, x0 : int(xs.max()) + 1], x0, y0))
    return found if len(found) >= 2 else []


def _cut(a: np.ndarray, w: int, mw: float, mh: float) -> tuple[list[Piece], str]:
    """The pieces of a box of width ``w`` whose part of the picture is ``a``, from left to right or by their parts, and how they were found; none if it stays whole."""
    n = _count(w, mw, mh)
    if n < 2 or w < LEAST_WIDTH or not a.size:
        return [], ""
    deep = _valleys(a)
    found = _between(a, deep[: n - 1]) if len(deep) >= n - 1 else []
    if found:
        return found, "valley"
    found = _touching(a, mh) if n == 2 else []
    if found:
        return found, "part"
    each = a.shape[1] // n
    return _between(a, [each * k for k in range(1, n)]) if w >= max(mw * EVEN[0], mh * EVEN[1]) and each >= 4 else [], "even"


def _inside(a: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The part of a picture in a box, counted from the box's corner."""
    return np.pad(a[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)], ((max(0, -y), 0), (max(0, -x), 0)))


def _split(a: np.ndarray, box: Piece, mw: float, mh: float) -> list[tuple]:
    """(path, x, y, w, h, how) of the pieces of a wide box."""
    work, done = [("", *box, "whole")], []
    while work:
        path, x, y, w, h, how = work.pop()
        found, by = _cut(_inside(a, x, y, w, h), w, mw, mh)
        if not found:
            done.append((path, x, y, w, h, how))
        for k, (px, py, pw, ph) in enumerate(found, 1):
            again = pw >= max(mw * AGAIN[0], mh * AGAIN[1]) and ph >= mh * AGAIN[2] and pw * ph < w * h
            (work if again else done).append((f"{path}.{k}" if path else str(k), x + px, y + py, pw, ph, by))
    return done


def drawn(runs: pa.StructArray, width: int, height: int) -> np.ndarray:
    """The picture of runs (y, x0, x1)."""
    y, x0, x1 = (runs.field(c).to_numpy() for c in ("y", "x0", "x1"))
    turns = np.zeros((height, width + 1), np.int8)
    np.add.at(turns, (y, x0), 1)
    np.add.at(turns, (y, x1 + 1), -1)
    return np.cumsum(turns, 1, dtype=np.int8)[:, :-1] > 0


def split_pictures(pictures: DataFrame, boxes: DataFrame) -> DataFrame:
    """``split_boxes`` of ``pictures`` (image_id, r, width, height), each with its runs (y, x0, x1) of ink."""
    own = boxes.select("image_id", "glyph_id", *[F.col(c).cast("long").alias(c) for c in BOX]).dropna()
    own = typical_sizes(own, F.collect_list(F.struct("glyph_id", *BOX)).alias("boxes"))
    whole = own.join(pictures.hint("merge"), "image_id", "left")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n, mw, mh, width, height = (b.column(c)[i].as_py() for c in ("n", "mw", "mh", "width", "height"))
                own, a, rows = b.column("boxes")[i].values, None, []
                for k, box in enumerate(zip(*[own.field(c).to_pylist() for c in BOX])):
                    if n < 2 or not width or box[2] < mw * WIDE[0] or box[3] < mh * WIDE[1]:
                        rows.append((k, "", *box, "whole"))
                        continue
                    if a is None:
                        r = b.column("r")[i]
                        a = drawn(r.values, width, height) if r.is_valid else np.zeros((height, width), bool)
                    rows += [(k, *piece) for piece in _split(a, box, mw, mh)]
                at, *columns = zip(*rows)
                kinds = (pa.string(), *[pa.int64()] * 4, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b.column("image_id").take(pa.array([i] * len(rows))), own.field("glyph_id").take(pa.array(at)), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["image_id", "glyph_id", "path", *BOX, "how"])

    kinds = [own.schema["image_id"], boxes.schema["glyph_id"], T.StructField("path", T.StringType()), *[T.StructField(c, T.LongType()) for c in BOX], T.StructField("how", T.StringType())]
    return whole.select("image_id", "n", "mw", "mh", "width", "height", "boxes", "r").mapInArrow(split, T.StructType(kinds))


def split_boxes(pixels: DataFrame, ink: Column, boxes: DataFrame) -> DataFrame:
    """(image_id, glyph_id, path, x, y, w, h, how) of ``boxes`` (image_id, glyph_id, x, y, w, h) with the wide ones split, by their pictures' pixels (image_id, y, x, ...).

    path says which piece of which piece a box is, '' for one left whole; how is valley, part, even, or whole."""
    marked = pixels.select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.coalesce(ink, F.lit(False)).alias("i"))
    rows = marked.groupBy("image_id", "y").agg(F.sort_array(F.collect_list(F.when(F.col("i"), F.col("x")))).alias("xs"), F.max("x").alias("last"))
    rows = rows.select("image_id", "y", "last", P.runs_in("xs").alias("r"))
    one = F.flatten(F.collect_list(F.transform("r", lambda r: F.struct(F.col("y"), r["x0"].alias("x0"), r["x1"].alias("x1")))))
    whole = rows.groupBy("image_id").agg(one.alias("r"), (F.max("last") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return split_pictures(whole, boxes)
