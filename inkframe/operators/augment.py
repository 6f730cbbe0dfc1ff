"""Augmented training characters: turned, scaled, sheared and shifted, with changed strokes and noise, then centred again.

Pictures are characters of 28 x 28, so one is a list of 784 numbers at most, and each copy is made from its own row: a copy costs no shuffle
until its ink is found. What is random comes from a digest of the seed, the copy's key and a name, as in ``drawing``: reruns agree,
repeats differ, and a lost task makes the same pictures again. A pixel is taken from the four around its place in the source, in 32nds.

Defined results: outside a picture everything is 0; a null picture has no copies; a class without spans of its own has those of ``OTHER``;
a copy that comes out in one shade is empty.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from . import filters
from . import pixels as P
from .drawing import uniform

SIDE = 28
# Fixed values of each class: largest angle, least and largest scale, largest shear, least and largest spread of the noise.
SPANS = {"*": (20.0, 0.82, 1.18, 0.18, 4.0, 10.0), "/": (12.0, 0.88, 1.14, 0.10, 3.0, 8.0)}
OTHER = (10.0, 0.90, 1.10, 0.08, 2.0, 6.0)
# Largest shift, chances of changed strokes, of wider ones then, and of a blur; its weights in 256ths; side that ink is fitted into.
SHIFT, CHANGED, WIDER, BLURRED, SOFT, INNER = 3, 0.35, 0.5, 0.18, (27, 202, 27), 20
#: Parts of a training set whose rows are augmented.
MADE = ("target", "feedback_more", "hard_more")
#: Copies that a task makes, about.
COPIES = 200


def draws(copies: DataFrame, key: Sequence[str], seed: str = "42") -> DataFrame:
    """``copies`` (label, *key) with how each is made: angle (degrees), scale, shear, noise, tx, ty, strokes (wider, thinner or null), soft."""
    def span(k: int) -> Column:
        out = F.lit(OTHER[k])
        for label, spans in SPANS.items():
            out = F.when(F.col("label") == label, spans[k]).otherwise(out)
        return out
    u = lambda name: uniform(name, F.lit(seed), *[F.col(c) for c in key])
    around = lambda name, k: (u(name) * 2 - 1) * span(k)
    between = lambda name, lo, hi: span(lo) + u(name) * (span(hi) - span(lo))
    shift = lambda name: F.floor(u(name) * (2 * SHIFT + 1)).cast("int") - SHIFT
    return copies.withColumns({
        "angle": around("angle", 0), "scale": between("scale", 1, 2), "shear": around("shear", 3), "noise": between("noise", 4, 5), "tx": shift("tx"), "ty": shift("ty"),
        "strokes": F.when(u("strokes") < CHANGED, F.when(u("wider") < WIDER, "wider").otherwise("thinner")), "soft": u("soft") < BLURRED})


def inverse() -> Column:
    """From a place in a copy to the place in its source: [a, b, c, d, e, f] with x = a x' + b y' + c and y = d x' + e y' + f."""
    c, middle = F.col, SIDE / 2
    turn = F.radians("angle")
    cos, sin = c("scale") * F.cos(turn), c("scale") * F.sin(turn)
    across, x0, y0 = sin + c("shear"), (1 - cos) * middle - sin * middle + c("tx"), sin * middle + (1 - cos) * middle + c("ty")
    whole = cos * cos + across * sin
    a, b, d = cos / whole, -across / whole, sin / whole
    return F.array(a, b, -a * x0 - b * y0, d, a, -d * x0 - a * y0)


def warped(picture: Column, back: Column) -> Column:
    """A list of lines gathered from ``picture`` by ``inverse``."""
    def pixel(p: Column, x: Column, y: Column) -> Column:
        u, v = F.shiftright(x, 5), F.shiftright(y, 5)
        near = lambda dx, dy: F.coalesce(F.get(F.get(p, v + dy), u + dx), F.lit(0))
        right, below = x.bitwiseAND(31), y.bitwiseAND(31)
        return F.shiftright(near(0, 0) * (32 - right) * (32 - below) + near(1, 0) * right * (32 - below) + near(0, 1) * (32 - right) * below + near(1, 1) * right * below + 512, 10)

    steps = F.sequence(F.lit(0), F.lit(SIDE - 1))
    fine = lambda v: F.rint(v * 1024).cast("int")

    def line(p: Column, m: Column, y: Column) -> Column:
        start = [fine(m[k + 1] * y + m[k + 2]) + 16 for k in (0, 3)]
        return F.transform(steps, lambda x: let([F.shiftright(fine(m[0] * x) + start[0], 5), F.shiftright(fine(m[3] * x) + start[1], 5)], lambda i, j: pixel(p, i, j)))

    return let([picture, back], lambda p, m: F.transform(steps, lambda y: line(p, m, y)))


def _restroked(picture: Column, line_best, both) -> Column:
    """The best of each pixel and those to the left, above, and above that one."""
    along = lambda rows: F.transform(rows, lambda r: filters.slid(r, F.lit(-1), F.lit(0), line_best))
    return let([along(picture)], lambda p: F.transform(p, lambda r, y: F.zip_with(r, F.coalesce(F.get(p, y - 1), r), lambda a, b: both(a, b))))


def _softened(picture: Column) -> Column:
    def mixed(rows: Column) -> Column:
        """Along x, not rounded; mirrored without the last pixel."""
        at = lambda r, x: F.get(r, F.when(x < 0, 1).when(x >= SIDE, SIDE - 2).otherwise(x).cast("int"))
        return F.transform(rows, lambda r: F.transform(r, lambda _, x: at(r, x - 1) * SOFT[0] + at(r, x) * SOFT[1] + at(r, x + 1) * SOFT[2]))
    up = lambda p: F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda x: F.transform(p, lambda r: F.get(r, x)))
    twice = let([mixed(picture)], lambda p: let([up(p)], lambda q: let([mixed(q)], up)))
    return F.transform(twice, lambda r: F.transform(r, lambda s: F.shiftright(s + 32768, 16)))


def changed(copies: DataFrame, key: Sequence[str], seed: str = "42") -> DataFrame:
    """``copies`` (label, picture, *key), picture a list of 28 lines, as (*key, picture): all that precedes finding its ink again."""
    d = draws(copies, key, seed).withColumn("picture", warped(F.col("picture"), inverse()))
    wider, thinner = _restroked(F.col("picture"), F.array_max, F.greatest), _restroked(F.col("picture"), F.array_min, F.least)
    d = d.withColumn("picture", F.when(F.col("strokes") == "wider", wider).when(F.col("strokes") == "thinner", thinner).otherwise(F.col("picture")))
    d = d.withColumn("picture", F.when(F.col("soft"), _softened(F.col("picture"))).otherwise(F.col("picture")))

    def noisy(v: Column, y: Column, x: Column) -> Column:
        own = [F.lit(seed), *[F.col(c) for c in key], y, x]
        normal = F.sqrt(-2.0 * F.log(F.greatest(uniform("pixel", *own), F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * uniform("pixel", *own, part=1))
        return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v + normal * F.col("noise")))).cast("int")

    return d.select(*key, F.transform("picture", lambda r, y: F.transform(r, lambda v, x: noisy(v, y, x))).alias("picture"))


def ink(of: filters.Lines) -> filters.Lines:
    """Ink as the lesser part of a blurred picture's two shades; a picture of one shade has none."""
    soft = filters.blurred(of, 3)
    dark = soft.join(P.otsu(filters.pixels_of(soft)), "glyph_id").withColumn("vs", let([F.col("vs"), F.col("threshold")], lambda vs, t: F.transform(vs, lambda v: v <= t)))
    share = dark.groupBy("glyph_id").agg(F.sum(F.size(F.filter("vs", lambda d: d))).alias("n"), F.sum(F.size("vs")).alias("all"))
    most = dark.select("glyph_id", "y", "vs").join(share.select("glyph_id", (F.col("n") > F.floor(F.col("all") / 2)).alias("most")), "glyph_id")
    return most.select("glyph_id", "y", let([F.col("vs"), F.col("most")], lambda vs, most: F.transform(vs, lambda d: F.when(d != most, 255).otherwise(0))).alias("vs"))


def fitted(of: filters.Lines) -> filters.Lines:
    """The ink box of each picture resampled to at most 20 x 20 in the middle of 28 x 28."""
    p = filters.pixels_of(of).filter("v > 0")
    size = lambda c: (F.max(c) - F.min(c) + 1).cast("int")
    box = p.groupBy("glyph_id").agg(F.min("x").cast("int").alias("x0"), F.min("y").cast("int").alias("y0"), size("x").alias("w"), size("y").alias("h"))
    scale = F.least(INNER / F.col("w"), INNER / F.col("h"))
    to = lambda c: F.greatest(F.lit(1), F.rint(F.col(c) * scale).cast("int"))
    box = box.withColumns({"nw": to("w"), "nh": to("h"), "grows": scale > 1})
    keep = ("nw", "nh")
    own = of.join(box, "glyph_id").filter("y >= y0 and y < y0 + h").select("glyph_id", (F.col("y") - F.col("y0")).cast("int").alias("y"), *keep, "grows", F.slice("vs", F.col("x0") + 1, F.col("w")).alias("vs"))
    nw, nh = F.col("nw"), F.col("nh")
    grown = filters.stretched(own.filter("grows").drop("grows"), nw, nh, *keep, by_area=True)
    scaled = grown.unionByName(filters.resized(own.filter("not grows").drop("grows"), nw, nh, *keep))
    before = lambda n: F.floor((SIDE - n) / 2).cast("int")
    none = lambda n: F.array_repeat(F.lit(0), n)
    put = scaled.select("glyph_id", (F.col("y") + before(nh)).alias("y"), F.concat(none(before(nw)), "vs", none(SIDE - nw - before(nw))).alias("vs"))
    frame = of.select("glyph_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))))
    return frame.join(put, ["glyph_id", "y"], "left").select("glyph_id", "y", F.coalesce("vs", none(F.lit(SIDE))).alias("vs"))


def augmented(copies: DataFrame, key: Sequence[str], seed: str = "42") -> DataFrame:
    """(*key, y, vs): the lines of each copy in ``copies`` (label, picture, *key), as a classifier learns them."""
    made = changed(copies.filter(F.col("picture").isNotNull()), key, seed)
    lines = made.select(F.struct(*key).alias("glyph_id"), F.posexplode("picture").alias("y", "vs"))
    lines = filters.staged(lines, "copies")  # read by several steps
    return fitted(filters.staged(ink(lines), "ink")).select(*[F.col(f"glyph_id.{c}").alias(c) for c in key], "y", "vs")


def training_pictures(rows: DataFrame, pictures: filters.Lines, seed: str = "42") -> DataFrame:
    """(part, id, copy, y, vs) of ``metrics.training_rows``: the pictures (glyph_id, y, vs) by id, those of the parts ``MADE`` augmented.
    Rows whose id has no picture are left out."""
    key = ("part", "id", "copy")
    whole = pictures.groupBy(F.col("glyph_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("y", "vs"))).alias("l")).select("id", F.transform("l", lambda r: r["vs"]).alias("picture"))
    both = rows.select(*key, "label").join(whole, "id")
    made = F.col("part").isin(*MADE)
    plain = both.filter(~made).select(*key, F.posexplode("picture").alias("y", "vs"))
    # the rows of a training set are small and would all be one task, but what is made of them is not
    tasks = max(1, math.ceil(rows.filter(made).count() / COPIES))
    return plain.unionByName(augmented(both.filter(made).repartition(tasks, *key), key, seed))
