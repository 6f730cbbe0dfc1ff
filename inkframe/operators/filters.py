"""Pictures as lines (glyph_id, y, vs): filters that look around a pixel, and what is made of them.

A line is one row of a picture, so that work along x is a list function and is dealt out line by line. What looks at several lines takes a
picture's lines together: ``each`` gathers them in one row and gives a small function the picture as an array, so a filter costs one shuffle of lines and none of
pixels, and a task holds one batch of pictures. Characters' parts, scores and choices are tables, joined by picture; a page is made ink in one go.

Results are those of the common 8-bit image operations: outside its frame a picture has nothing for minima and maxima, is mirrored without its
last pixel for Gaussian blurs, and repeats its last pixel for medians and local means.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import let
from ..sources.staged import staged
from . import pixels as P

# Fixed values of the background's estimate: least spread to act on, least kernel, its part of the shorter side, side to shrink to, least kernel then, least mean after.
SPREAD, KERNEL, PART, SMALL_SIDE, SMALL_KERNEL, LEAST_MEAN = 18.0, 61, 6, 600, 11, 5.0
# Fixed values of contrast: clip limits by mean brightness, tiles a side, rows and columns of the bright-detail kernel.
CLIPS, TILES, DETAIL = ((30, 4.0), (60, 3.0), (None, 2.0)), 8, 15
# Fixed values of thresholds: local blocks (least, part of the shorter side, most), offsets, a character's block; least parts (pixels, share).
BLOCKS, OFFSETS, CHARACTER_BLOCK, SPECKS, DARK_SPECKS = (21, 0.04, 51), (-2, -5), 21, (6, 0.00002), (20, 0.00003)
# Fixed values of dark strokes: least kernel, part of the shorter side, most.
DARK_KERNEL = (15, 0.05, 61)
# Fixed values of a normalised character: side, inner side, and how much larger it is below a fill, with the margin that stays.
SIDE, INNER, THIN = 28, 22, ((0.18, 2, 4), (0.12, 4, 3))

#: Lines of pages that a task filters, about.
LINES_TAKEN = 20_000

Lines = DataFrame


def lines(pixels: DataFrame, *keep: str) -> Lines:
    """(glyph_id, y, *keep, vs) of a whole picture's pixels (glyph_id, y, x, v, *keep)."""
    g = pixels.groupBy("glyph_id", F.col("y").cast("int").alias("y"), *keep).agg(F.sort_array(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), "v"))).alias("p"))
    return g.select("glyph_id", "y", *keep, F.transform("p", lambda p: p["v"]).alias("vs"))


def pixels_of(of: Lines, *keep: str) -> DataFrame:
    return of.select("glyph_id", F.col("y").cast("long").alias("y"), *keep, F.posexplode("vs").alias("x", "v")).withColumn("x", F.col("x").cast("long"))


def _rows_of(of: pa.Array) -> np.ndarray:
    """The array of a picture's lines (y, vs)."""
    vs = of.field("vs")
    return vs.flatten().to_numpy(zero_copy_only=False).reshape(len(vs), -1)


def each(of: Lines, f: Callable[..., np.ndarray], *keep: str, about: dict[str, Column] | None = None, kind: str = "int") -> Lines:
    """(glyph_id, y, *keep, vs): ``f`` of each picture as an array, with the values ``about`` the picture; ``keep`` are columns that a picture's lines share."""
    named = {f"about_{k}": v for k, v in (about or {}).items()}
    names = list(about or {})
    whole = of.withColumns(named) if named else of
    whole = whole.groupBy("glyph_id").agg(*[F.first(c).alias(c) for c in (*keep, *named)], F.sort_array(F.collect_list(F.struct("y", "vs"))).alias("l"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared, values = ["glyph_id", *keep], {k: b.column(f"about_{k}").to_pylist() for k in names}
            for i in range(b.num_rows):
                out = f(_rows_of(b.column("l")[i].values), **{k: v[i] for k, v in values.items()})
                lines = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel().astype(np.int32 if kind == "int" else np.float64)))
                own = [b.column(c).take(pa.array(np.full(len(out), i))) for c in shared]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(len(out), dtype=np.int32)), lines], [*shared, "y", "vs"])

    fields = [whole.schema["glyph_id"], *[whole.schema[c] for c in keep], T.StructField("y", T.IntegerType()), T.StructField("vs", T.ArrayType(T.IntegerType() if kind == "int" else T.DoubleType()))]
    return whole.mapInArrow(made, T.StructType(fields)).select("glyph_id", "y", *keep, "vs")


def turned(of: Lines, *keep: str) -> Lines:
    """The columns as lines."""
    return each(of, np.transpose, *keep, kind="int" if of.schema["vs"].dataType.elementType in (T.IntegerType(), T.LongType()) else "double")


def sizes(of: Lines) -> DataFrame:
    """(glyph_id, w, h) of each picture."""
    return of.groupBy("glyph_id").agg(F.max(F.size("vs")).alias("w"), (F.max("y") + 1).alias("h"))


def _along(vs: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """The list of body(line, its length, x) for every x."""
    return let([vs], lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 1), lambda x: body(v, F.size(v), x)))


def _at(v: Column, i: Column) -> Column:
    return F.element_at(v, i.cast("int") + 1)


def _clamped(n: Column, i: Column) -> Column:
    return F.greatest(F.lit(0), F.least(n - 1, i))


# --- minima and maxima

def slid(vs: Column, lo: Column, hi: Column, best: Callable[[Column], Column]) -> Column:
    """The best of the pixels from x + lo to x + hi that lie in the picture; lo <= 0 <= hi."""
    def body(v, n, x):
        first = F.greatest(F.lit(0), x + lo)
        return best(F.slice(v, first + 1, F.least(n - 1, x + hi) - first + 1))
    return _along(vs, body)


def _shifted(a: np.ndarray, lo: int, hi: int, axis: int, both: Callable) -> np.ndarray:
    """The best of the pixels from lo to hi along an axis that lie in the picture; lo <= 0 <= hi."""
    a = np.moveaxis(a, axis, 0)
    out = a.copy()
    for d in range(lo, hi + 1):
        if 0 < d < len(a):
            both(out[:-d], a[d:], out=out[:-d])
        elif -len(a) < d < 0:
            both(out[-d:], a[:d], out=out[-d:])
    return np.moveaxis(out, 0, axis)


def _under(a: np.ndarray, w: int, h: int, both: Callable) -> np.ndarray:
    return _shifted(_shifted(a, -(w // 2), w - 1 - w // 2, 1, both), -(h // 2), h - 1 - h // 2, 0, both)


def closed(of: Lines, w: int, h: int, *keep: str) -> Lines:
    """Maxima, then minima, under a rectangle of w x h whose anchor is its middle, the later one if even."""
    return each(of, lambda a: _under(_under(a, w, h, np.maximum), w, h, np.minimum), *keep)


def opened(of: Lines, w: int, h: int, *keep: str) -> Lines:
    return each(of, lambda a: _under(_under(a, w, h, np.minimum), w, h, np.maximum), *keep)


def _under_ellipse(a: np.ndarray, k: int, both: Callable) -> np.ndarray:
    """The best of the pixels under an ellipse of k x k: that of each line within 0, 1, ... pixels to both sides is found once, from the one before."""
    r = k // 2
    reach = [int(np.rint(r * math.sqrt((r * r - dy * dy) / (r * r)))) for dy in range(r + 1)]
    out, level = a.copy(), a
    for dx in range(r + 1):
        level = _shifted(level, -1, 1, 1, both) if dx else level
        for dy in (d for d in range(min(r, len(a) - 1) + 1) if reach[d] == dx):
            both(out[dy:], level[: len(a) - dy], out=out[dy:])
            both(out[: len(a) - dy], level[dy:], out=out[: len(a) - dy])
    return out


def closed_by_ellipse(of: Lines, k: Column, *keep: str) -> Lines:
    """Maxima, then minima, under an ellipse of k x k, k odd."""
    return each(of, lambda a, k: _under_ellipse(_under_ellipse(a, k, np.maximum), k, np.minimum), *keep, about={"k": k})


# --- weighted means

def _weighed(a: np.ndarray, weights: np.ndarray, mirrored: bool) -> np.ndarray:
    """Weighted sums around each pixel of a line; outside, a line is mirrored without its last pixel or repeats it."""
    n, r, x = a.shape[1], len(weights) // 2, np.arange(a.shape[1])
    out = np.zeros(a.shape, weights.dtype)
    for d in range(-r, r + 1):
        i = x + d
        i = np.where(i < 0, -i, np.where(i > n - 1, 2 * (n - 1) - i, i)) if mirrored else i
        out += a[:, np.clip(i, 0, n - 1)] * weights[d + r]
    return out


def _weighed_both(a: np.ndarray, weights: np.ndarray, mirrored: bool) -> np.ndarray:
    return _weighed(_weighed(a, weights, mirrored).T, weights, mirrored).T


def _blur(a: np.ndarray, size: int) -> np.ndarray:
    weights = np.array([math.comb(size - 1, i) for i in range(size)])
    whole = int(weights.sum()) ** 2
    return (_weighed_both(a, weights, True) + whole // 2) // whole


def _smooth(a: np.ndarray) -> np.ndarray:
    return np.where(_weighed_both(a, np.ones(3, int), False) >= 5 * 255, 255, 0)


def _close(a: np.ndarray, k: int = 3) -> np.ndarray:
    return _under(_under(a, k, k, np.maximum), k, k, np.minimum)


def _open(a: np.ndarray, k: int) -> np.ndarray:
    return _under(_under(a, k, k, np.minimum), k, k, np.maximum)


def blurred(of: Lines, size: int, *keep: str) -> Lines:
    """Gaussian blur of 3 or 5 pixels by binomial weights, rounded half up."""
    return each(of, lambda a: _blur(a, size), *keep)


def smoothed(of: Lines, *keep: str) -> Lines:
    """Of ink (255) and ground (0): what most of the nine pixels around are."""
    return each(of, _smooth, *keep)


def _mean_around(a: np.ndarray, block: int) -> np.ndarray:
    sigma, r = 0.3 * ((block - 1) * 0.5 - 1) + 0.8, block // 2
    raw = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return np.rint(np.round(_weighed_both(a, raw / raw.sum(), False), 6))


def local_means(of: Lines, block: Column | int, *keep: str) -> Lines:
    """(glyph_id, y, vs of (v, m)): with each pixel the mean around it, weighted by a Gaussian of ``block`` pixels (odd, over 7) and rounded."""
    means = each(of, lambda a, block: a.astype(np.int64) * 1024 + _mean_around(a, block).astype(np.int64), *keep, about={"block": F.lit(block) if isinstance(block, int) else block})
    return means.withColumn("vs", F.transform("vs", lambda p: F.struct(F.shiftright(p, 10).alias("v"), p.bitwiseAND(1023).alias("m"))))


def _ink(test: Column) -> Column:
    return F.when(test, 255).otherwise(0)


def above_means(means: Lines, offset: int) -> Lines:
    """Ink where a pixel is lighter than the mean around it less ``offset``."""
    return means.withColumn("vs", F.transform("vs", lambda p: _ink(p["v"] - p["m"] > -offset)))


def _levels(a: np.ndarray) -> np.ndarray:
    """Ink above the grey level that best parts a picture in two, the lowest of equals."""
    v, n = np.unique(a, return_counts=True)
    n0, s0 = np.cumsum(n), np.cumsum(n * v)
    apart = (s0 * n0[-1] - s0[-1] * n0).astype(float)
    between = np.divide(apart * apart, n0 * (n0[-1] - n0.astype(float)), out=np.zeros(len(v)), where=n0 < n0[-1])
    return np.where(a > v[np.round(between, 3).argmax()], 255, 0)


def above_otsu(of: Lines, *keep: str) -> Lines:
    return each(of, _levels, *keep)


# --- background and contrast

def _odd(c: Column) -> Column:
    return F.floor(c).cast("int").bitwiseOR(1)


def shrunk(of: Lines, to: Column, *keep: str) -> Lines:
    """Each line resampled to ``to`` pixels by the area that they cover, not rounded."""
    def cell(v, n, step, j):
        lo, hi = j * step, (j + 1) * step
        first, last = F.floor(lo + 1e-9).cast("int"), F.least(n - 1, F.ceil(hi - 1e-9).cast("int") - 1)
        return F.aggregate(F.sequence(first, F.greatest(first, last)), F.lit(0.0), lambda a, i: a + _at(v, i) * F.greatest(F.lit(0.0), F.least(hi, i + 1.0) - F.greatest(lo, i * 1.0))) / step
    whole = lambda vs, to: let([vs, F.size(vs) / to], lambda v, step: F.transform(F.sequence(F.lit(0), to - 1), lambda j: cell(v, F.size(v), step, j)))
    return of.withColumn("vs", whole(F.transform("vs", lambda v: v.cast("double")), to)).select("glyph_id", "y", *keep, "vs")


def _stretched(vs: Column, to: Column, by_area: bool) -> Column:
    """For each of ``to`` pixels (first, second, weights in 2048ths of both): the pixels to take it from. ``by_area``: the first one
    alone as long as it covers the pixel."""
    def place(n, j):
        f = j * n / to if by_area else (j + 0.5) * n / to - 0.5
        i = F.floor(f).cast("int")
        inside = (i >= 0) & (i < n - 1)
        over = F.greatest(F.lit(0.0), (j + 1) - (i + 1) * to / n)
        part = F.when(inside, over - F.floor(over) if by_area else f - i).otherwise(0.0)
        at = _clamped(n, i)
        return F.struct(at.alias("a"), F.least(n - 1, at + 1).alias("b"), F.bround((1 - part) * 2048).cast("int").alias("wa"), F.bround(part * 2048).cast("int").alias("wb"))
    return let([vs], lambda v: F.transform(F.sequence(F.lit(0), to - 1), lambda j: place(F.size(v), j)))


def stretched(of: Lines, w: Column, h: Column, *keep: str, by_area: bool = False) -> Lines:
    """Pictures resampled to w x h from the two nearest pixels along each axis, in 2048ths."""
    along = let([F.col("vs"), _stretched(F.col("vs"), w, by_area)], lambda v, places: F.transform(places, lambda p: _at(v, p["a"]) * p["wa"] + _at(v, p["b"]) * p["wb"]))
    up = turned(of.withColumn("vs", along), *keep)
    part = lambda s, weight: F.shiftright(weight * F.shiftright(s, 4), 16)
    down = let([F.col("vs"), _stretched(F.col("vs"), h, by_area)], lambda v, places: F.transform(places, lambda p: F.shiftright(part(_at(v, p["a"]), p["wa"]) + part(_at(v, p["b"]), p["wb"]) + 2, 2)))
    return turned(up.withColumn("vs", down), *keep)


def resized(of: Lines, w: Column, h: Column, *keep: str) -> Lines:
    """Pictures shrunk to w x h by area, rounded half to even."""
    up = turned(shrunk(of, w, *keep), *keep)
    return turned(shrunk(up, h, *keep).withColumn("vs", F.transform("vs", lambda v: F.bround(F.round(v, 6)).cast("int"))), *keep)


def _evened(a: np.ndarray, ground: np.ndarray) -> np.ndarray:
    even = np.minimum(255, a * 128 // np.maximum(1, ground))
    return even if even.mean() >= LEAST_MEAN else a


def _even(a: np.ndarray) -> np.ndarray:
    """``even_background`` of a picture that is not large."""
    s1, s2, side = int(a.sum()), int((a.astype(np.int64) ** 2).sum()), min(a.shape)
    if max(a.shape) > SMALL_SIDE or math.sqrt(float(a.size * s2 - s1 * s1)) / a.size < SPREAD:
        return a
    k = max(KERNEL, int(side / PART) | 1)
    return _evened(a, _under_ellipse(_under_ellipse(a, k, np.maximum), k, np.minimum))


def _evenly(of: Lines, then: Callable[[np.ndarray], np.ndarray] = lambda a: a) -> Lines:
    """``then`` of each picture with an even background; a picture that is not large passes both in one go."""
    of = staged(of, "pictures", by="glyph_id", taken=LINES_TAKEN)
    large = of.filter((F.size("vs") > SMALL_SIDE) | (F.col("y") >= SMALL_SIDE)).select("glyph_id").distinct()
    if large.isEmpty():
        return each(of, lambda a: then(_even(a)))
    own = of.join(large, "glyph_id", "left_semi")
    total = lambda f: F.sum(F.aggregate("vs", F.lit(0).cast("long"), lambda a, v: a + f(v)))
    n, s1, s2 = F.sum(F.size("vs")), total(lambda v: v), total(lambda v: v * v)
    about = own.groupBy("glyph_id").agg((F.sqrt((n * s2 - s1 * s1).cast("double")) / n).alias("spread"), F.max(F.size("vs")).alias("w"), (F.max("y") + 1).cast("int").alias("h")).filter(F.col("spread") >= SPREAD)
    scale = SMALL_SIDE / F.greatest("w", "h")
    k = F.greatest(F.lit(SMALL_KERNEL), _odd(F.greatest(F.lit(KERNEL), _odd(F.least("w", "h") / PART)) * scale))
    small = lambda c: F.floor(F.col(c) * scale).cast("int")
    about = staged(about.select("glyph_id", "w", "h", k.alias("k"), small("w").alias("sw"), small("h").alias("sh")), "about")
    rest = each(of.join(about, "glyph_id", "left_anti"), lambda a: then(_even(a)))
    keep = ("w", "h", "k", "sw", "sh")
    own = own.join(about, "glyph_id")
    shrunken = resized(own.select("glyph_id", "y", *keep, "vs"), F.col("sw"), F.col("sh"), *keep)
    ground = stretched(closed_by_ellipse(shrunken, F.col("k"), *keep), F.col("w"), F.col("h"), *keep).select("glyph_id", "y", F.col("vs").alias("ground"))
    both = own.join(ground, ["glyph_id", "y"]).select("glyph_id", "y", F.zip_with("vs", "ground", lambda v, g: v * 65536 + g).alias("vs"))
    return rest.unionByName(each(both, lambda a: then(_evened(a >> 16, a & 65535))))


def even_background(of: Lines) -> Lines:
    """Ink over an estimate of the ground's brightness, which is the picture closed by a large ellipse; pictures of little spread, and
    those that would come out too dark, stay as they are."""
    return _evenly(of)


def _curves(tiles: np.ndarray, clip: float) -> np.ndarray:
    """The curve of each tile's (clipped) histogram; tiles: tiles x pixels."""
    n, area = tiles.shape
    counts = np.bincount((np.arange(n)[:, None] * 256 + tiles).ravel(), minlength=n * 256).reshape(n, 256)
    most = max(1, int(clip * area / 256))
    over = np.maximum(0, counts - most).sum(1)
    batch, rest = over // 256, over % 256
    step = np.maximum(1, 256 // np.maximum(1, rest))[:, None]
    i = np.arange(256)
    counts = np.minimum(counts, most) + batch[:, None] + ((i % step == 0) & (i // step < rest[:, None]))
    return np.minimum(255, np.rint(np.round(np.cumsum(counts, 1) * 255.0 / area, 6))).astype(int)


def _contrast(a: np.ndarray) -> np.ndarray:
    h, w = a.shape
    clip = next(c for least, c in CLIPS if least is None or a.mean() < least)
    # a picture that does not fit is widened along both axes, by a whole tile's worth along one that fits; pixels beyond the frame repeat those before it, mirrored
    th, tw = (h // TILES, w // TILES) if h % TILES == 0 and w % TILES == 0 else (h // TILES + 1, w // TILES + 1)
    inside = lambda n, to: np.where(np.arange(to) < n, np.arange(to), 2 * (n - 1) - np.arange(to))
    ey, ex = inside(h, th * TILES), inside(w, tw * TILES)
    wide = a[np.maximum(ey, 0)][:, np.maximum(ex, 0)]
    curves = _curves(wide.reshape(TILES, th, TILES, tw).swapaxes(1, 2).reshape(TILES * TILES, th * tw), clip).reshape(TILES, TILES, 256)

    def near(n: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = np.arange(n) / t - 0.5
        low = np.floor(f).astype(int)
        return np.maximum(0, low), np.minimum(TILES - 1, low + 1), f - low

    (y1, y2, b), (x1, x2, c) = near(h, th), near(w, tw)
    at = lambda y: curves[y[:, None], x1[None, :], a] * (1 - c) + curves[y[:, None], x2[None, :], a] * c
    return np.rint(np.round(at(y1) * (1 - b)[:, None] + at(y2) * b[:, None], 6))


def equalized(of: Lines) -> Lines:
    """Contrast by the histograms of 8 x 8 tiles, clipped; a pixel takes the curves of the four nearest tiles, by distance."""
    return each(of, _contrast)


def enhanced(of: Lines) -> Lines:
    """Even background, contrast by tiles, a blur, and bright detail added again."""
    return _evenly(of, _detailed)


def _detailed(a: np.ndarray) -> np.ndarray:
    soft = _blur(_contrast(a).astype(int), 5)
    return np.minimum(255, 2 * soft - _open(soft, DETAIL))


# --- ink of whole pictures and of characters

def without_small_parts(of: Lines, c: tuple[int, float]) -> Lines:
    """Ink in parts of some area, or else in the largest one."""
    of = staged(of, "mask")
    runs = staged(P.labelled_runs(runs_of(of)), "parts")
    least = sizes(of).select("glyph_id", F.greatest(F.lit(c[0]), F.floor(F.col("w") * F.col("h") * c[1])).alias("least"))
    parts = runs.groupBy("glyph_id", "part").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area")).join(least, "glyph_id")
    return drawn_runs(of, runs.join(P.without_specks(parts, F.col("least")).select("glyph_id", "part"), ["glyph_id", "part"]))


def runs_of(of: Lines) -> DataFrame:
    """(glyph_id, y, x0, x1) of the runs of pixels above 0, x1 the last one."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pc.list_value_length(b.column("vs")).to_numpy()
            ink, line = b.column("vs").flatten().to_numpy() > 0, np.repeat(np.arange(len(n)), n)
            begins, same = (np.cumsum(n) - n)[line], line[1:] == line[:-1]
            first, last = (np.flatnonzero(ink & ~np.concatenate(p)) for p in (([False], ink[:-1] & same), (ink[1:] & same, [False]))) if len(ink) else (np.empty(0, int),) * 2
            x0, x1 = (pa.array((x - begins[x]).astype(np.int32)) for x in (first, last))
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(line[first])) for c in ("glyph_id", "y")], x0, x1], ["glyph_id", "y", "x0", "x1"])

    own = of.select("glyph_id", F.col("y").cast("int").alias("y"), "vs")
    return own.mapInArrow(found, T.StructType([own.schema["glyph_id"], *[T.StructField(c, T.IntegerType()) for c in ("y", "x0", "x1")]]))


def drawn_runs(of: Lines, runs: DataFrame) -> Lines:
    """Pictures of the frames of ``of`` that have ink where ``runs`` (glyph_id, y, x0, x1) are."""
    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, k = b.column("n").to_numpy(), pc.list_value_length(b.column("runs")).to_numpy()
            end, r = np.cumsum(n), b.column("runs").flatten()
            at = np.repeat(end - n, k)
            turns = np.zeros(int(n.sum()) + 1, np.int32)
            np.add.at(turns, at + r.field("x0").to_numpy(), 1)
            np.add.at(turns, at + r.field("x1").to_numpy() + 1, -1)
            vs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], end)).astype(np.int32)), pa.array(np.where(np.cumsum(turns)[:-1] > 0, 255, 0).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("glyph_id"), b.column("y"), vs], ["glyph_id", "y", "vs"])

    g = runs.groupBy("glyph_id", F.col("y").cast("int").alias("y")).agg(F.collect_list(F.struct(F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))).alias("runs"))
    own = of.select("glyph_id", F.col("y").cast("int").alias("y"), F.size("vs").alias("n")).join(g, ["glyph_id", "y"], "left")
    own = own.withColumn("runs", F.coalesce("runs", F.expr("cast(array() as array<struct<x0:int,x1:int>>)")))
    return own.mapInArrow(drawn, T.StructType([own.schema["glyph_id"], T.StructField("y", T.IntegerType()), T.StructField("vs", T.ArrayType(T.IntegerType()))]))


def measured(of: Lines) -> DataFrame:
    """(glyph_id, n, size, edge, width, height, box) of pixels above 0: how many, of how many, share of the frame (corners count twice), area of their box."""
    ink = F.transform("vs", lambda v: v > 0)
    at = lambda a: F.array_position(a, True).cast("int")
    d = of.select("glyph_id", "y", F.size("vs").alias("w"), ink.alias("i")).select("glyph_id", "y", "w", F.size(F.filter("i", lambda v: v)).alias("k"), (F.get("i", 0).cast("int") + F.element_at("i", -1).cast("int")).alias("ends"), at(F.col("i")).alias("first"), (F.col("w") - at(F.reverse("i")) + 1).alias("last"))
    some = lambda c: F.when(F.col("k") > 0, F.col(c))
    width, height = F.max("w"), F.max("y") + 1
    return d.groupBy("glyph_id").agg(
        F.sum("k").alias("n"), F.sum("w").alias("size"), ((F.min_by("k", "y") + F.max_by("k", "y") + F.sum("ends")) / (2 * width + 2 * height)).alias("edge"), width.alias("width"), height.alias("height"),
        ((F.max(some("last")) - F.min(some("first")) + 1) * (F.max(some("y")) - F.min(some("y")) + 1)).alias("box"))


def _runs(a: np.ndarray) -> tuple[np.ndarray, ...]:
    """(y, x0, x1, part) of the runs of pixels above 0, part as in ``pixels.labelled_runs``."""
    turns = np.diff((a > 0).astype(np.int8), axis=1, prepend=0, append=0)
    (y, x0), x1 = np.nonzero(turns == 1), np.nonzero(turns == -1)[1] - 1
    return y, x0, x1, P.hanging_together(y, x0, x1, 1) if len(y) else y


def _large_parts(a: np.ndarray, c: tuple[int, float]) -> np.ndarray:
    """``without_small_parts`` of one picture."""
    y, x0, x1, part = _runs(a)
    if not len(y):
        return a
    area = np.bincount(part, x1 - x0 + 1)
    kept = area >= max(c[0], int(a.size * c[1]))
    kept = kept if kept.any() else np.arange(len(area)) == area.argmax()
    turns = np.zeros((a.shape[0], a.shape[1] + 1), np.int8)
    own = kept[part]
    turns[y[own], x0[own]] += 1
    turns[y[own], x1[own] + 1] -= 1
    return np.where(np.cumsum(turns, 1)[:, :-1] > 0, 255, 0)


def _score(a: np.ndarray) -> float | None:
    """``pixels.threshold_scored`` of one picture; none without ink."""
    t, (height, width), ink = P.THRESHOLD_SCORE, a.shape, a > 0
    y, x0, x1, part = _runs(a)
    if not len(y):
        return None
    first, at = np.unique(part, return_inverse=True)
    area = np.bincount(at, x1 - x0 + 1)
    ends = lambda f, start, of: (out := np.full(len(first), start), f.at(out, at, of))[0]
    w, h = ends(np.maximum, -1, x1) - ends(np.minimum, width, x0) + 1, ends(np.maximum, -1, y) - ends(np.minimum, height, y) + 1
    least = lambda pair, of: max(pair[0], int(of * pair[1]))
    noise = int((area < max(6, int(a.size * 0.00004))).sum())
    lines = int(((w >= width * t["line_width"]) & (h <= least(t["line_height"], height))).sum())
    chars = int(((h >= least(t["char_height"], height)) & (w <= least(t["char_width"], width))).sum())
    edge = int(ink[0].sum() + ink[-1].sum() + ink[:, 0].sum() + ink[:, -1].sum()) / (2 * width + 2 * height)
    return -abs(int(ink.sum()) / a.size - t["share"]) - edge * t["edge"] - min(noise, t["noise_cap"]) * t["noise"] - lines * t["line"] + min(chars, t["char_cap"]) * t["char"]


def _binary(a: np.ndarray) -> np.ndarray:
    """Ink by the best of the three thresholds, and which one it is, as 256 times its number."""
    block = min(BLOCKS[2], max(BLOCKS[0], round(min(a.shape) * BLOCKS[1]) | 1))
    apart = a - _mean_around(a, block)
    found = [np.where(apart > -o, 255, 0) for o in OFFSETS] + [_levels(a)]
    clean = [_large_parts(_close(_smooth(f)), SPECKS) for f in found]
    scores = [-math.inf if s is None else s for s in map(_score, clean)]
    best = scores.index(max(scores))
    return clean[best] + 256 * best


def _chosen(of: Lines) -> Lines:
    return of.select("glyph_id", "y", F.transform("vs", lambda v: v.bitwiseAND(255)).alias("vs"), F.shiftright(F.get("vs", F.lit(0)), 8).alias("candidate"))


def binarized(of: Lines) -> Lines:
    """Ink of an enhanced picture by the best of two local thresholds and one for the whole picture."""
    return _chosen(each(of, _binary))


def binarized_pages(of: Lines) -> Lines:
    """``binarized`` of ``enhanced`` pictures, in one go."""
    return _chosen(_evenly(of, lambda a: _binary(_detailed(a).astype(np.int32))))


def dark_strokes(of: Lines) -> Lines:
    """Ink of a grey picture of dark strokes: what an elliptic closing fills."""
    def hat(a: np.ndarray) -> np.ndarray:
        k = min(DARK_KERNEL[2], max(DARK_KERNEL[0], round(min(a.shape) * DARK_KERNEL[1]) | 1))
        return _under_ellipse(_under_ellipse(a, k, np.maximum), k, np.minimum) - a

    return without_small_parts(each(of, lambda a: _close(_smooth(_levels(_blur(hat(a), 5))))), DARK_SPECKS)


def canvas_strokes(of: Lines) -> Lines:
    """Ink of a grey canvas: darker than the whole picture's threshold."""
    return without_small_parts(each(of, lambda a: _close(255 - _levels(_blur(a, 5)))), SPECKS)


def one_character(of: Lines) -> Lines:
    """Ink of a character's largest part and of those that belong to it; one part or none stays as it is."""
    of = staged(of, "mask")
    runs = staged(P.labelled_runs(runs_of(of)), "parts")
    n = F.col("x1") - F.col("x0") + 1
    parts = runs.groupBy("glyph_id", "part").agg(
        F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.sum(n).alias("area"),
        (F.sum(n * (F.col("x0") + F.col("x1")) / 2) / F.sum(n)).alias("cx"), (F.sum(n * F.col("y")) / F.sum(n)).alias("cy"))
    return drawn_runs(of, runs.join(P.dominant_parts(parts).select("glyph_id", "part"), ["glyph_id", "part"]))


def character_ink(of: Lines) -> Lines:
    """Ink of a character's ink map (light on dark) by the better of a threshold and local means."""
    of = staged(of, "map")
    own = lambda f: each(of, lambda a: _open(_smooth(f(_blur(a, 3))), 2))
    found = [own(_levels), own(lambda a: np.where(a - _mean_around(a, CHARACTER_BLOCK) > -OFFSETS[0], 255, 0))]
    clean = [staged(one_character(f).withColumn("candidate", F.lit(i)), "candidate") for i, f in enumerate(found)]
    scores = [P.binary_scored(measured(c)).withColumn("candidate", F.lit(i)) for i, c in enumerate(clean)]
    every = sizes(of).select("glyph_id").withColumn("candidate", F.explode(F.array(F.lit(0), F.lit(1))))
    best = P.best_thresholds(every.join(scores[0].unionByName(scores[1]), ["glyph_id", "candidate"], "left"))
    return clean[0].unionByName(clean[1]).join(best, ["glyph_id", "candidate"]).select("glyph_id", "y", "vs", "candidate")


def _strong(a: np.ndarray) -> np.ndarray:
    two = lambda a, both: both(_shifted(a, -1, 0, 1, both), _shifted(a, -1, 0, 0, both))
    healed = two(two(a, np.maximum), np.minimum)
    y, x = np.nonzero(healed)
    bw, bh = (np.ptp(x) + 1, np.ptp(y) + 1) if len(x) else (0, 0)
    return two(healed, np.maximum) if min(bw, bh) >= 6 and len(x) / (bw * bh) < 0.20 else healed


def strengthened(of: Lines) -> Lines:
    """Small breaks closed, and thin strokes widened, by a pixel to the left and above."""
    return each(of, _strong)


def centred(of: Lines) -> Lines:
    """Characters of 28 x 28: the ink box resampled to the inner side, put in the middle, and moved by its centre of mass."""
    of = staged(of, "characters")
    p = pixels_of(of)
    ink = F.col("v") > 0
    x, y = (F.when(ink, F.col(c)) for c in "xy")
    box = p.groupBy("glyph_id").agg(F.min(x).alias("x0"), F.min(y).alias("y0"), (F.max(x) - F.min(x) + 1).cast("int").alias("w"), (F.max(y) - F.min(y) + 1).cast("int").alias("h"), F.count_if(ink).alias("n"))
    fill = F.col("n") / (F.col("w") * F.col("h"))
    inner = F.lit(INNER)
    for least, more, margin in THIN:
        inner = F.when(fill < least, min(SIDE - margin, INNER + more)).otherwise(inner)
    other = lambda a, b: F.greatest(F.lit(1), F.bround(F.col(a) * F.col("inner") / F.col(b)).cast("int"))
    tall = F.col("h") >= F.col("w")
    to = box.filter("n > 0").withColumn("inner", inner).withColumns({"nw": F.when(tall, other("w", "h")).otherwise(F.col("inner")), "nh": F.when(tall, F.col("inner")).otherwise(other("h", "w"))})
    keep = ("nw", "nh", "grows")
    to = staged(to, "boxes")
    own = of.join(to, "glyph_id").filter("y >= y0 and y < y0 + h").select("glyph_id", (F.col("y") - F.col("y0")).cast("int").alias("y"), "nw", "nh", (F.greatest("nw", "nh") > F.greatest("w", "h")).alias("grows"), F.slice("vs", F.col("x0").cast("int") + 1, F.col("w")).alias("vs"))
    nw, nh = F.col("nw"), F.col("nh")
    scaled = stretched(own.filter("grows"), nw, nh, *keep).unionByName(resized(own.filter("not grows"), nw, nh, *keep))
    put = pixels_of(scaled, *keep).select("glyph_id", (F.col("y") + F.floor((SIDE - nh) / 2)).alias("y"), (F.col("x") + F.floor((SIDE - nw) / 2)).alias("x"), "v").filter("v > 0")
    put = staged(put, "put")
    mass = put.groupBy("glyph_id").agg(*[F.bround(SIDE / 2 - F.sum(F.col("v") * F.col(c)) / F.sum("v")).cast("int").alias(f"d{c}") for c in "xy"])
    moved = put.join(mass, "glyph_id").select("glyph_id", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "v")
    frame = of.select("glyph_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    return lines(frame.join(moved, ["glyph_id", "y", "x"], "left").select("glyph_id", "y", "x", F.coalesce("v", F.lit(0)).cast("int").alias("v")))


def normalized(of: Lines) -> Lines:
    """A character's ink, cleaned, strengthened, cleaned again and centred."""
    strong = staged(strengthened(staged(one_character(of), "character")), "strong")
    return centred(staged(one_character(strong), "character"))


def preprocessed(of: Lines) -> Lines:
    """A classifier's input from a character's ink map."""
    return centred(character_ink(of).drop("candidate"))
