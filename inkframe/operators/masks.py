"""Lines in masks of ink, by algebra on runs (glyph_id, y, x0, x1): ruled lines, vertical guides, and strokes that lie on a ruled line.

A picture is the table of its runs of ink along a row, with the row's last place as ``mx``; a run's ends move under maxima and minima along
the row, and runs that meet are merged, so closing and opening cost what there are runs, whatever the kernel's length, and no row is drawn
pixel by pixel. For columns x and y change places.

A picture's runs stay in one task: staged tables are dealt by picture, and steps join and group by it, so that a task's memory is that of some pictures,
however many there are.

Lines that hang together count as one, corners too. A line that lies wholly in a hole of another one counts as its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staged import staged, tasks_of
from . import pixels as P

Runs = DataFrame

# Of ruled lines, least length and healed gap (pixels, parts of the width), most height (pixels, part of the height); of a high line, its least fullest row (pixels, part of its width) and rows kept around it.
RULED = {"span": (24, 0.28), "gap": (5, 0.05), "height": (4, 0.10), "full": (8.0, 0.45), "around": 3, "frame": (4, 16)}
# Of guides, least height and most width (pixels, parts), bounds of fill, how many make each one certain, distance to the frame of others.
GUIDES = {"height": (24, 0.72), "width": (8, 0.030), "fill": (0.05, 0.92), "repeated": 4, "edge": 2, "frame": 8}
# Fixed values of grid removal: least run of ink (pixels, part of the width), and bounds of its guides.
GRID = {"run": (40, 0.25), "guide_height": 0.78, "guide_width": 0.022}
# Fixed values of strokes on a line: least line (pixels, part), margins, area, width and its most (pixels, part), height (pixels, part), fill, aspect, overlap.
STROKES = {"line": (64, 0.45), "pad": (2, 6), "area": 8, "width": 8, "most": (42, 0.12), "height": (6, 0.72), "fill": 0.18, "aspect": 2.2, "overlap": 4}


def row_runs(pixels: DataFrame, ink: Column) -> Runs:
    """(glyph_id, y, x0, x1, mx, my): the runs of ``ink``; mx and my are the picture's last column and row."""
    rows = pixels.filter(F.col("glyph_id").isNotNull()).groupBy("glyph_id", "y").agg(F.max("x").alias("mx"), F.sort_array(F.collect_list(F.when(ink, F.col("x")))).alias("xs"))
    picture = Window.partitionBy("glyph_id")
    rows = rows.withColumns({"mx": F.max("mx").over(picture).cast("int"), "my": F.max("y").over(picture).cast("int")})
    runs = rows.select("glyph_id", "y", F.inline(P.runs_in("xs")), "mx", "my")
    return runs.select("glyph_id", *[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")], "mx", "my")


def column_runs(pixels: DataFrame, ink: Column) -> Runs:
    """The same along columns: y is a column, x0 and x1 are rows in it."""
    turned = pixels.withColumn("ink_", ink).select("glyph_id", F.col("x").alias("y"), F.col("y").alias("x"), "ink_")
    return row_runs(turned, F.col("ink_"))


def _key(runs: Runs) -> list[str]:
    return [c for c in runs.columns if c not in ("x0", "x1")]


def merged(runs: Runs) -> Runs:
    """Runs of a row that overlap or touch, as one."""
    key = _key(runs)
    order = Window.partitionBy("glyph_id", "y", *[c for c in key if c == "band"]).orderBy("x0", "x1")
    fresh = F.col("x0") > F.coalesce(F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-2)) + 1
    isle = runs.withColumn("fresh_", fresh.cast("int")).withColumn("isle_", F.sum("fresh_").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return isle.groupBy(*key, "isle_").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).select(*runs.columns)


def dilated(runs: Runs, k: Column) -> Runs:
    """Maxima under ``k`` pixels of a row, the anchor in the middle or after it."""
    half = F.floor(k / 2).cast("int")
    wide = runs.withColumns({"x0": F.greatest(F.lit(0), F.col("x0") - (k - 1 - half)).cast("int"), "x1": F.least(F.col("mx"), F.col("x1") + half).cast("int")})
    return merged(wide)


def eroded(runs: Runs, k: Column) -> Runs:
    """Minima under ``k`` pixels of a row; what lies outside the frame takes nothing away."""
    half = F.floor(k / 2).cast("int")
    x0 = F.when(F.col("x0") == 0, 0).otherwise(F.col("x0") + half).cast("int")
    x1 = F.when(F.col("x1") == F.col("mx"), F.col("mx")).otherwise(F.col("x1") - (k - 1 - half)).cast("int")
    return runs.withColumns({"x0": x0, "x1": x1}).filter("x0 <= x1")


def closed(runs: Runs, k: Column) -> Runs:
    return eroded(dilated(runs, k), k)


def opened(runs: Runs, k: Column) -> Runs:
    return dilated(eroded(runs, k), k)


def united(a: Runs, b: Runs, tasks: int | None = None) -> Runs:
    """``tasks``, here and below: how many the pictures are dealt to."""
    return merged(_dealt(a.unionByName(b.select(*a.columns)), tasks))


def _dealt(runs: Runs, tasks: int | None) -> Runs:
    return runs.repartition(tasks, "glyph_id").hint("merge") if tasks else runs


def without(a: Runs, b: Runs, tasks: int | None = None) -> Runs:
    """The parts of a's runs that no run of b covers."""
    key = [c for c in _key(a) if c not in ("glyph_id", "y")]
    holes = b.select("glyph_id", "y", *[F.lit(None).cast(a.schema[c].dataType).alias(c) for c in key], "x0", "x1", F.lit(True).alias("hole"))
    rows = _dealt(merged(a).withColumn("hole", F.lit(False)).unionByName(holes), tasks).groupBy("glyph_id", "y").agg(  # runs of one row
        F.collect_list(F.when(~F.col("hole"), F.struct(*key, "x0", "x1"))).alias("runs"), F.array_sort(F.collect_list(F.when(F.col("hole"), F.struct(F.col("x0").cast("int").alias("x0"), F.col("x1").cast("int").alias("x1"))))).alias("holes"))
    d = rows.select("glyph_id", "y", "holes", F.inline("runs"))
    start = F.struct(F.col("x0").cast("int").alias("at"), F.expr("cast(array() as array<struct<x0:int,x1:int>>)").alias("out"))

    def cut(acc: Column, h: Column) -> Column:
        piece = F.when(h["x0"] > acc["at"], F.array(F.struct(acc["at"].alias("x0"), (h["x0"] - 1).cast("int").alias("x1")))).otherwise(F.expr("cast(array() as array<struct<x0:int,x1:int>>)"))
        return F.struct(F.greatest(acc["at"], (h["x1"] + 1).cast("int")).alias("at"), F.concat(acc["out"], piece).alias("out"))

    near = F.filter("holes", lambda h: (h["x1"] >= F.col("x0")) & (h["x0"] <= F.col("x1")))
    done = F.aggregate(near, start, cut)
    end = F.struct(done["at"].alias("x0"), F.col("x1").cast("int").alias("x1"))
    pieces = F.filter(F.concat(done["out"], F.array(end)), lambda p: p["x0"] <= p["x1"])
    return d.select(*_key(a), F.explode(pieces).alias("p")).select(*_key(a), "p.x0", "p.x1").select(*a.columns)


def boxes(runs: Runs) -> DataFrame:
    """(glyph_id, part, bx, by, bw, bh, area, mx, my) of what hangs together."""
    own = staged(P.labelled_runs(runs.select("glyph_id", "y", "x0", "x1")), "parts", by="glyph_id")
    g = own.groupBy("glyph_id", "part").agg(F.min("x0").alias("bx"), F.min("y").alias("by"), (F.max("x1") - F.min("x0") + 1).alias("bw"), (F.max("y") - F.min("y") + 1).alias("bh"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    return g.join(runs.select("glyph_id", "mx", "my").distinct(), "glyph_id")


def inside(runs: Runs, some: DataFrame) -> Runs:
    """The parts of ``runs`` inside boxes (glyph_id, bx, by, bw, bh)."""
    j = runs.join(some.select("glyph_id", "bx", "by", "bw", "bh"), "glyph_id").filter("y >= by and y < by + bh and x1 >= bx and x0 < bx + bw")
    return merged(j.withColumns({"x0": F.greatest("x0", "bx").cast("int"), "x1": F.least(F.col("x1"), F.col("bx") + F.col("bw") - 1).cast("int")}).select(*runs.columns))


def _least(pair: tuple[int, Column | float], last: str) -> Column:
    return F.greatest(F.lit(pair[0]), F.bround((F.col(last) + 1) * pair[1]).cast("int"))


def ruled_lines(runs: Runs, lower: bool = False, span: Column | float = RULED["span"][1], gap: float = RULED["gap"][1], height: float = RULED["height"][1]) -> Runs:
    """Runs of horizontal lines whose gaps are healed; a high one gives the rows around its fullest row. ``lower``: only those of the lower part of the picture.

    span, gap, height: parts of the picture's width and height."""
    r = RULED
    span, gap, most = _least((r["span"][0], span), "mx"), _least((r["gap"][0], gap), "mx"), _least((r["height"][0], height), "my")
    big = runs.filter((F.col("my") + 1 >= r["frame"][0]) & (F.col("mx") + 1 >= r["frame"][1]))
    seed = staged(closed(opened(closed(big, gap), span), F.greatest(F.lit(3), F.floor(gap / 2).cast("int"))), "seed", by="glyph_id")
    found = boxes(seed).filter(F.col("bw") >= span)
    if lower:
        found = found.filter(F.col("by") + F.col("bh") / 2.0 >= (F.col("my") + 1) * 0.40)
    low, high = found.filter(F.col("bh") <= most), found.filter(F.col("bh") > most)
    rows = inside_rows(seed, high).withColumn("k", F.row_number().over(Window.partitionBy("glyph_id", "part").orderBy(F.desc("n"), "y"))).filter("k = 1")
    full = rows.withColumn("peak", F.col("y")).filter(F.col("n") >= F.greatest(F.lit(r["full"][0]), F.col("bw") * r["full"][1]))
    half = F.greatest(F.lit(1), F.least(F.floor(most / 2).cast("int"), F.lit(r["around"])))
    top, end = F.greatest(F.col("by"), F.col("peak") - half), F.least(F.col("by") + F.col("bh"), F.col("peak") + half + 1)
    cut = full.select("glyph_id", "bx", top.alias("by"), "bw", (end - top).alias("bh"))
    return inside(seed, low.select("glyph_id", "bx", "by", "bw", "bh").unionByName(cut))


def inside_rows(runs: Runs, some: DataFrame) -> DataFrame:
    """(glyph_id, part, bx, by, bw, bh, mx, my, y, n): ink in each row of each of the ``boxes``."""
    box = ["part", "bx", "by", "bw", "bh", "mx", "my"]
    j = runs.select("glyph_id", "y", "x0", "x1").join(some.select("glyph_id", *box), "glyph_id").filter("y >= by and y < by + bh and x1 >= bx and x0 < bx + bw")
    return j.groupBy("glyph_id", *box, "y").agg(F.sum(F.least(F.col("x1"), F.col("bx") + F.col("bw") - 1) - F.greatest("x0", "bx") + 1).alias("n"))


def guides(columns: Runs, height: float = GUIDES["height"][1], width: float = GUIDES["width"][1]) -> Runs:
    """Vertical guides, from and as runs along columns (x and y changed): high, narrow, and many, or else at the frame."""
    g = GUIDES
    # along columns a picture's height is mx + 1 and its width my + 1
    least_up = _least((g["height"][0], height), "mx")
    least_down = F.greatest(F.lit(g["height"][0]), F.floor((F.col("mx") + 1) * height).cast("int"))
    seed = staged(opened(columns.filter((F.col("mx") + 1 >= g["frame"]) & (F.col("my") + 1 >= g["frame"])), least_up), "seed", by="glyph_id")
    fits = boxes(seed).filter((F.col("bw") >= least_down) & (F.col("bh") <= _least((g["width"][0], width), "my")))
    inked = inside_rows(seed, fits).groupBy("glyph_id", "part", "bx", "by", "bw", "bh", "mx", "my").agg(F.sum("n").alias("n"))
    fits = inked.filter((F.col("n") / (F.col("bw") * F.col("bh"))).between(*g["fill"]))
    fits = fits.withColumn("many", F.count("*").over(Window.partitionBy("glyph_id")))
    at_frame = (F.col("by") <= g["edge"]) | (F.col("by") + F.col("bh") >= F.col("my") + 1 - g["edge"])
    return inside(seed, fits.filter((F.col("many") >= g["repeated"]) | at_frame))


def grid_lines(pixels: DataFrame, ink: Column) -> DataFrame:
    """(glyph_id, y, x) of ruled lines and guides to be taken away."""
    runs = staged(row_runs(pixels, ink), "runs", by="glyph_id")
    tasks = tasks_of(runs)
    long = opened(runs, F.greatest(F.lit(GRID["run"][0]), F.floor((F.col("mx") + 1) * GRID["run"][1]).cast("int")))
    across = pixels_of(united(long, ruled_lines(runs), tasks))
    down = pixels_of(guides(column_runs(pixels, ink), GRID["guide_height"], GRID["guide_width"])).select("glyph_id", F.col("x").alias("y"), F.col("y").alias("x"))
    return _dealt(across.unionByName(down), tasks).distinct()


def pixels_of(runs: Runs) -> DataFrame:
    """(glyph_id, y, x)."""
    return runs.select("glyph_id", F.col("y").cast("long").alias("y"), F.explode(F.sequence(F.col("x0").cast("long"), F.col("x1").cast("long"))).alias("x"))


def without_strokes(ink: Runs, ruled: Runs) -> Runs:
    """``ruled`` less the columns of its long lines where a short, dense stroke lies on them, so that the stroke outlives the line's removal.

    Strokes of one line are looked at in the order of their first pixel: columns that one has freed don't count for the next. Lines are looked at each on its own."""
    s, ruled, tasks = STROKES, staged(ruled, "ruled", by="glyph_id"), tasks_of(ink)
    lines = boxes(ruled).filter(F.col("bw") >= _least(s["line"], "mx"))
    pad = F.greatest(F.lit(s["pad"][0]), F.least(F.lit(s["pad"][1]), F.col("bh") + 2))
    bands = staged(lines.select("glyph_id", F.col("part").alias("band"), "bx", "bw", F.greatest(F.lit(0), F.col("by") - pad).alias("top"), F.least(F.col("my") + 1, F.col("by") + F.col("bh") + pad).alias("end"), F.col("mx").alias("last")), "bands")
    # the band's rest of ink, as a picture of its own, healed by one pixel
    rest = without(ink, ruled, tasks).drop("mx", "my").join(bands, "glyph_id").filter("y >= top and y < end and x1 >= bx and x0 < bx + bw")
    band = ["glyph_id", "band", "bx", "bw", "top", "end", "last"]
    own = rest.select(*band, "y", F.greatest(F.lit(0), F.col("x0") - F.col("bx")).cast("int").alias("x0"), F.least(F.col("bw") - 1, F.col("x1") - F.col("bx")).cast("int").alias("x1"), (F.col("bw") - 1).cast("int").alias("mx"))
    healed = closed(own, F.lit(3))
    # parts of a band: bands are told apart by a picture's key of their own, which holds all that is known of them
    named = healed.select(F.struct(*band).alias("glyph_id"), "y", "x0", "x1").repartition(tasks, "glyph_id")
    parts = staged(P.labelled_runs(named), "parts", by="glyph_id").groupBy("glyph_id", "part").agg(
        F.min("x0").alias("cx"), (F.max("x1") - F.min("x0") + 1).alias("cw"), (F.max("y") - F.min("y") + 1).alias("ch"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min(F.struct("y", "x0")).alias("first"))
    parts = parts.select("glyph_id.*", "cx", "cw", "ch", "area", "first")
    c = F.col
    fits = staged(parts.filter(
        (c("area") >= s["area"]) & (c("cw") >= s["width"]) & (c("cw") <= _least(s["most"], "last")) & (c("ch") <= F.greatest(F.lit(s["height"][0]), F.bround((c("end") - c("top")) * s["height"][1]).cast("int")))
        & (c("cx") > 1) & (c("cx") + c("cw") < c("bw") - 1) & (c("area") / (c("cw") * c("ch")) >= s["fill"]) & (c("cw") / c("ch") >= s["aspect"])), "strokes", by="glyph_id")
    strokes = fits.groupBy("glyph_id", "band", "bx", "bw", "top", "end").agg(F.array_sort(F.collect_list(F.struct("first", c("cx").cast("int").alias("cx"), c("cw").cast("int").alias("cw")))).alias("parts"))
    # the line's runs in a band that has a stroke: as many lie over a column as it has ink of the line
    cover = ruled.select("glyph_id", "y", "x0", "x1").join(strokes, "glyph_id").filter("y >= top and y < end and x1 >= bx and x0 < bx + bw")
    ordered = cover.groupBy("glyph_id", "band", "bx", "bw", "top", "end").agg(F.first("parts").alias("parts"), F.collect_list(F.struct((c("x0") - c("bx")).alias("a"), (c("x1") - c("bx")).alias("b"))).alias("line"))
    none = F.expr("cast(array() as array<struct<a:int,b:int>>)")

    def step(freed: Column, p: Column) -> Column:
        free = lambda x: F.exists(freed, lambda q: (q["a"] <= x) & (x <= q["b"]))
        inked = lambda x: F.size(F.filter("line", lambda r: (r["a"] <= x) & (x <= r["b"])))
        over = F.aggregate(F.sequence(p["cx"], p["cx"] + p["cw"] - 1), F.lit(0), lambda a, x: a + F.when(free(x), 0).otherwise(inked(x)))
        return F.when(over >= F.greatest(F.lit(s["overlap"]), p["cw"]), F.concat(freed, F.array(F.struct(p["cx"].alias("a"), (p["cx"] + p["cw"] - 1).cast("int").alias("b"))))).otherwise(freed)

    freed = ordered.select("glyph_id", "bx", "top", "end", F.explode(F.aggregate("parts", none, step)).alias("q"))
    gone = freed.select("glyph_id", F.explode(F.sequence(c("top").cast("int"), (c("end") - 1).cast("int"))).alias("y"), (c("bx") + c("q.a")).cast("int").alias("x0"), (c("bx") + c("q.b")).cast("int").alias("x1"))
    return without(ruled, gone, tasks_of(ruled))
