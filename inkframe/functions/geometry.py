"""Predicates and measures of boxes (x, y, w, h) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """Four columns that stand for a box: columns with a prefix, or the fields of a struct."""

    def __init__(self, prefix: str | Column = ""):
        self.x, self.y, self.w, self.h = (F.col(prefix + c) if isinstance(prefix, str) else prefix[c] for c in "xywh")

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def center_y(self) -> Column:
        return self.y + self.h / 2


def inside(inner: Box, outer: Box, pad: int = 0) -> Column:
    return (inner.x >= outer.x - pad) & (inner.y >= outer.y - pad) & (inner.right <= outer.right + pad) & (inner.bottom <= outer.bottom + pad)


def intersection(a: Box, b: Box) -> Column:
    wide = F.least(a.right, b.right) - F.greatest(a.x, b.x)
    high = F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)
    return F.greatest(F.lit(0), wide) * F.greatest(F.lit(0), high)


def overlap_ratio(a: Box, b: Box) -> Column:
    """Common area over the smaller box's."""
    return F.coalesce(F.try_divide(intersection(a, b).cast("double"), F.least(a.area, b.area).cast("double")), F.lit(0.0))


def union(a: Box, b: Box) -> list[Column]:
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    return [x.alias("x"), y.alias("y"), (F.greatest(a.right, b.right) - x).alias("w"), (F.greatest(a.bottom, b.bottom) - y).alias("h")]


def line_like(box: Box, width: int, height: int) -> Column:
    """Wide and flat against the picture's size."""
    return (box.w >= width * 0.18) & (box.h <= max(18, int(height * 0.03)))


def char_count(ratio: Column) -> Column:
    """How many characters a box is wide, from its width over the median."""
    return F.when(ratio < 1.55, 1).when(ratio < 2.45, 2).when(ratio < 3.45, 3).otherwise(F.bround(ratio).cast("int"))


def capped_count(w: Column, median_w: Column, median_h: Column) -> Column:
    """``char_count`` of a width; a box much narrower than the boxes are high is counted by their height."""
    by_height = w / median_h.cast("double")
    ratio = w / median_w.cast("double")
    ratio = F.when((median_h > 0) & (by_height < 0.6), F.least(ratio, by_height * 1.5)).otherwise(ratio)
    return F.when(median_w <= 0, 1).otherwise(char_count(ratio))


def padded(box: Box, width: Column | int, height: Column | int, ratio: float = 0.15) -> list[Column]:
    """The box with a margin on all sides, inside the picture: x0, y0, x1, y1."""
    pad = F.greatest(F.lit(4), F.bround(F.greatest(box.w, box.h) * ratio).cast("int"))
    edge = lambda v: F.lit(v) if isinstance(v, int) else v
    return [
        F.greatest(F.lit(0), box.x - pad).alias("x0"), F.greatest(F.lit(0), box.y - pad).alias("y0"),
        F.least(edge(width), box.right + pad).alias("x1"), F.least(edge(height), box.bottom + pad).alias("y1"),
    ]


def as_list(box: Box) -> Column:
    """The box as a list of whole numbers."""
    return F.array(*[v.cast("int") for v in (box.x, box.y, box.w, box.h)])


def bound(measures: dict[str, Column], tests: list[tuple]) -> Column:
    """Whether all tests hold. A test is (measure, sense, constant, (measure, factor), ...): the measure is compared
    with the largest of the constant and the scaled measures, ``least`` in front of them takes the smallest."""
    out = F.lit(True)
    for name, sense, *terms in tests:
        pick = F.greatest
        if terms[0] == "least":
            pick, terms = F.least, terms[1:]
        values = [measures[t[0]] * F.lit(float(t[1])) if isinstance(t, tuple) else F.lit(float(t)) for t in terms]
        limit = pick(*values) if len(values) > 1 else values[0]
        own = measures[name]
        out = out & {"<=": own <= limit, ">=": own >= limit, "<": own < limit, ">": own > limit, "=": own == limit}[sense]
    return out


def pair_measures(a: Box, b: Box, **more: Column) -> dict[str, Column]:
    """Distances and sizes of two boxes: of both, of the left and right (1, 2), of the upper and lower (u, d) and of
    the smaller and larger one (s, l), the first one of equals before. ``more`` adds medians and ink measures."""
    def first(test: Column, c: str) -> tuple[Column, Column]:
        p, q = getattr(a, c), getattr(b, c)
        return F.when(test, p).otherwise(q), F.when(test, q).otherwise(p)

    left, above, small = b.x >= a.x, b.y >= a.y, a.area <= b.area
    m = dict(more)
    for c in "xywh":
        for (p, q), test in ((("1", "2"), left), (("u", "d"), above), (("s", "l"), small)):
            m[p + c], m[q + c] = first(test, c)
    # in a pair of equal areas the left one is the smaller
    m |= {"small": F.least(a.area, b.area), "large": F.greatest(a.area, b.area)}
    zero = F.lit(0)
    m["gap_x"] = F.greatest(zero, m["2x"] - (m["1x"] + m["1w"]))
    m["gap_u"] = F.greatest(zero, m["dx"] - (m["ux"] + m["uw"]))
    m["gap_any_x"] = F.greatest(zero, F.greatest(a.x, b.x) - F.least(a.right, b.right))
    m["gap_y"] = F.greatest(zero, F.greatest(a.y, b.y) - F.least(a.bottom, b.bottom))
    m["drop"] = F.greatest(zero, m["dy"] - (m["uy"] + m["uh"]))
    m["over_x"] = F.greatest(zero, F.least(a.right, b.right) - F.greatest(a.x, b.x))
    m["over_y"] = F.greatest(zero, F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))
    m["cw"] = F.greatest(a.right, b.right) - F.least(a.x, b.x)
    m["ch"] = F.greatest(a.bottom, b.bottom) - F.least(a.y, b.y)
    m["apart_y"] = F.abs(a.center_y - b.center_y)
    m["apart_x"] = F.abs((a.x + a.w / 2) - (b.x + b.w / 2))
    m["max_w"], m["min_w"] = F.greatest(a.w, b.w), F.least(a.w, b.w)
    m["max_h"], m["min_h"] = F.greatest(a.h, b.h), F.least(a.h, b.h)
    m["aspect"] = m["cw"] / F.greatest(F.lit(1), m["ch"])
    m["even"] = m["min_h"] / F.greatest(F.lit(1), m["max_h"])
    m["s_end"], m["s_bottom"] = m["sx"] + m["sw"], m["sy"] + m["sh"]
    m["into_left"] = m["s_end"] - m["lx"]  # how far the smaller one reaches into the larger from its left side
    m["into_right"] = m["lx"] + m["lw"] - m["sx"]
    m["into_top"] = m["s_bottom"] - m["ly"]
    m["into_bottom"] = m["ly"] + m["lh"] - m["sy"]
    m["lower_1"] = m["1y"] - m["2y"]
    return m


# Bounds of the fragments that belong together, on the measures above; mw and mh are the medians.
DASH = [("w", ">=", 10, ("mw", .18)), ("w", "<=", 30, ("mw", .70)), ("h", "<=", 6, ("mh", .16)), ("ratio", ">=", 2.6), ("fill", ">=", .18)]
X_LIKE = [("w", ">=", 18, ("mw", .55)), ("w", "<=", 44, ("mw", 1.20)), ("h", ">=", 18, ("mh", .24)), ("h", "<=", 46, ("mh", .72)), ("ratio", ">=", .60), ("ratio", "<=", 1.40), ("fill", ">=", .18), ("fill", "<=", .55),
          ("center", ">=", .35), ("diag_primary", ">=", .52), ("diag_secondary", ">=", .52), ("diag_apart", "<=", .25)]
SPARSE_SEVEN = [("w", ">=", 14, ("mw", .60)), ("w", "<=", 76, ("mw", 1.25)), ("h", ">=", 80, ("mh", 1.15)), ("ratio", ">=", .22), ("ratio", "<=", .58), ("fill", ">=", .04), ("fill", "<=", .11), ("top", ">=", .12), ("bottom", "<=", .08), ("parts", ">=", 2), ("parts", "<=", 3)]
DIGIT = [("gap_x", "<=", 3, ("mw", .08), ("mh", .05)), ("over_y", ">=", ("min_h", .55)), ("even", ">=", .72), ("aspect", ">=", .52), ("aspect", "<=", 1.18)]
LOOP = [("holes", "=", 1), ("max_w", "<=", 120, ("mw", 1.20)), ("cw", "<=", 180, ("mw", 1.75)), ("ch", "<=", 190, ("mh", 1.35))]
LOOP_FILL = [("fill", ">=", .14), ("fill", "<=", .48)]
SLIM = [("max_w", "<=", 42, ("mh", .40)), ("cw", "<=", 68, ("mh", .78)), ("holes", ">=", 1), ("fill", ">=", .10), ("fill", "<=", .42)]
TOP_BAR = [("uh", "<=", 18, ("mh", .22)), ("uw", ">=", 22, ("mw", .70)), ("dw", "<=", 14, ("mw", .25)), ("dh", "<=", 42, ("mh", .40)), ("gap_u", "<=", 18, ("mw", .32)), ("drop", ">=", 20, ("mh", .40)), ("cw", "<=", 72, ("mw", 1.25)), ("ch", "<=", 190, ("mh", 1.80))]
SATELLITE = [("small", "<=", 900, ("large", .35)), ("sw", "<=", 42, ("mw", .68)), ("sh", "<=", 52, ("mh", .46)), ("gap_any_x", "<=", 18, ("mw", .32)), ("over_y", ">=", ("sh", .45)), ("apart_y", "<=", 28, ("lh", .38)), ("cw", "<=", 150, ("mw", 2.35)), ("ch", "<=", ("lh", 1.15), ("mh", 1.15))]
SATELLITE_SIDES = [[("into_left", "<=", 8, ("lw", .38))], [("into_right", "<=", 8, ("lw", .38))]]
SHORT_LEFT = [("gap_x", "<=", 26, ("mw", .42)), ("1h", "<=", ("2h", .72)), ("1w", ">=", 28, ("2w", .75)), ("1w", "<=", 52, ("mw", .82)), ("2w", "<=", 44, ("mw", .70)), ("2h", ">=", 92, ("mh", .90)), ("over_y", ">=", ("1h", .82)), ("lower_1", ">=", 6, ("2h", .05)), ("reach_2", "<=", 112, ("mw", 1.78)), ("ch", "<=", 150, ("mh", 1.25))]
STAGGERED = [("gap_x", "<=", 10, ("mw", .20)), ("over_y", ">=", ("min_h", .18)), ("apart_y", ">=", 18, ("mh", .28)), ("cw", "<=", 92, ("mw", 2.10)), ("ch", "<=", 180, ("mh", 2.00)), ("max_w", "<=", 72, ("mw", 1.15)), ("min_h", ">=", 26, ("mh", .45)), ("fill", ">=", .07), ("fill", "<=", .46), ("parts", "<=", 3)]
OFFSET = [("small", "<=", 850, ("large", .28)), ("sw", "<=", 32, ("mw", .55)), ("sh", "<=", 62, ("mh", .65)), ("gap_x", "<=", 42, ("mw", .95)), ("apart_y", "<=", 28, ("mh", .38)), ("cw", "<=", 124, ("mw", 2.10)), ("ch", "<=", 170, ("mh", 1.35)), ("fill", ">=", .04), ("fill", "<=", .48), ("parts", "<=", 4)]
OFFSET_SIDES = [[("into_left", "<=", 12, ("lw", .28))], [("into_right", "<=", 12, ("lw", .28))]]
INLINE = [("cw", "<=", 118, ("mw", 1.58)), ("ch", "<=", 190, ("mh", 1.45)), ("gap_y", "<=", 18, ("mh", .18)), ("apart_y", "<=", 34, ("mh", .36)), ("fill", ">=", .05), ("fill", "<=", .55), ("holes", "<=", 2), ("parts", "<=", 3)]
INLINE_TOUCH = [[("gap_x", "<=", 8, ("mw", .12))], [("over_x", ">=", 3, ("min_w", .15))]]
INLINE_SMALL = [[("small", "<=", 1100, ("large", .42))], [("sw", "<=", 28, ("mw", .40))], [("sh", "<=", 34, ("mh", .34))]]
INLINE_TWO_TALL = [("1h", ">=", ("mh", .8)), ("2h", ">=", ("mh", .8)), ("gap_x", ">=", 2, ("mw", .05))]
INLINE_FULL = [("sh", ">=", 72, ("mh", .82)), ("sw", ">=", 18, ("mw", .26)), ("small", ">=", 1500, ("m_area", .22)), ("over_x", "<=", 2, ("sw", .10)), ("gap_x", ">=", 4, ("mw", .06))]
INLINE_EDGES = [[("into_left", "<=", 10, ("lw", .34))], [("into_right", "<=", 10, ("lw", .34))], [("sx", ">=", ("lx", 1)), ("into_right", ">=", ("sw", 1))],
                [("into_top", "<=", 12, ("lh", .34))], [("into_bottom", "<=", 12, ("lh", .34))], [("sy", ">=", ("ly", 1)), ("into_bottom", ">=", ("sh", 1))]]
INLINE_MEET = [[("over_y", ">=", ("min_h", .12))], [("gap_y", "<=", 8, ("mh", .08))]]
CORNER = [("cw", "<=", 32, ("mw", 1.62)), ("ch", "<=", 194, ("mh", 1.55)), ("small", "<=", 1000, ("large", .34)), ("sw", "<=", 24, ("mw", .34)), ("sh", "<=", 48, ("mh", .52)), ("over_y", "<=", ("sh", .55)), ("gap_y", "<=", 32, ("mh", .28)), ("fill", ">=", .05), ("fill", "<=", .50), ("parts", "<=", 4)]
CORNER_TOUCH = [[("over_x", ">=", 4, ("sw", .22))], [("gap_x", "<=", 8, ("mw", .10))]]
CORNER_ENDS = [[("into_top", "<=", 18, ("lh", .34))], [("into_bottom", "<=", 18, ("lh", .34))]]


def _any(m: dict[str, Column], choices: list[list[tuple]]) -> Column:
    out = F.lit(False)
    for tests in choices:
        out = out | bound(m, tests)
    return out


def pair_rules(m: dict[str, Column]) -> dict[str, Column]:
    """The rules by which two neighbouring fragments are one character, in the order in which they are asked."""
    m = m | {"reach_2": m["2x"] + m["2w"] - m["1x"], "m_area": m["mh"] * m["mw"]}
    small = m | {"w": m["sw"], "h": m["sh"], "ratio": m["sw"] / F.greatest(F.lit(1), m["sh"]), "fill": m["small_fill"]}
    own = {"center": m["small_center"], "diag_primary": m["small_diag"], "diag_secondary": m["small_diag2"], "diag_apart": F.abs(m["small_diag"] - m["small_diag2"])}
    loop = bound(m, LOOP)
    return {
        "digit": bound(m, DIGIT) & ((loop & bound(m, LOOP_FILL)) | (~loop & bound(m, SLIM))),
        "top_bar": bound(m, TOP_BAR),
        "satellite": bound(m, SATELLITE) & _any(m, SATELLITE_SIDES),
        "short_left": bound(m, SHORT_LEFT),
        "staggered": bound(m, STAGGERED),
        "offset": bound(m, OFFSET) & _any(m, OFFSET_SIDES) & ~bound(small, DASH) & ~bound(small | own, X_LIKE),
        "inline": bound(m, INLINE) & _any(m, INLINE_TOUCH) & _any(m, INLINE_SMALL) & ~bound(m, INLINE_TWO_TALL) & ~bound(m, INLINE_FULL) & _any(m, INLINE_EDGES) & _any(m, INLINE_MEET),
        "corner": bound(m, CORNER) & _any(m, CORNER_TOUCH) & _any(m, CORNER_ENDS),
    }


# When parts of a broken stroke are one, on the measures of a pair.
BROKEN_STACKED = [("over_ratio", ">=", .40), ("apart_x", "<=", 10, ("min_w", .45), ("mw", .35)), ("apart_y", ">=", 6, ("min_h", .22)), ("gap_y", "<=", 18, ("mh", .35)), ("cw", "<=", ("max_w", 1.40), ("mw", 1.40)), ("ch", "<=", ("mh", 1.80), ("max_h", 2.20))]
BROKEN_NEIGHBOURS = [("min_w", ">=", ("mw", .50)), ("gap_any_x", "<=", 10, ("mw", .18)), ("apart_y", "<=", 10, ("mh", .22)), ("over_y", ">=", ("min_h", .45))]
BROKEN_VERTICAL = [("gap_y", "<=", 12, ("mh", .18)), ("apart_y", ">=", 8, ("min_h", .20)), ("over_x", ">=", ("min_w", .20)), ("apart_x", "<=", 10, ("mw", .45), ("min_w", .60))]
BROKEN_HORIZONTAL = [("over_y", ">", ("min_h", .4)), ("gap_any_x", "<=", 4, ("min_w", .12)), ("cw", "<=", ("max_w", 1.6))]
BROKEN_SPECK = [("least_side", "<=", 14), ("gap_any_x", "<=", 12), ("gap_y", "<=", 12)]
BROKEN_WIDTH = [("cw", "<=", ("max_w", 1.3), ("mw", 1.3))]


def broken(m: dict[str, Column]) -> Column:
    """Whether two boxes are parts of one broken stroke."""
    m = m | {"over_ratio": m["over_x"] / F.greatest(F.lit(1), m["min_w"]), "least_side": F.least(m["min_w"], m["min_h"])}
    close = bound(m, BROKEN_VERTICAL) | bound(m, BROKEN_HORIZONTAL) | bound(m, BROKEN_SPECK)
    return bound(m, BROKEN_WIDTH) & (bound(m, BROKEN_STACKED) | (~bound(m, BROKEN_NEIGHBOURS) & close))
