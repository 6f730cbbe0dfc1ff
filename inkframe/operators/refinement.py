"""From glyphs with classes and measures to the characters of a line that make up an expression.

A line is a row with its glyphs as a list of structs, sorted from left to right. What a glyph alone
decides are columns; what depends on what was decided to the left is a fold over the list. Decision
lists are tables of rules, first match first.

A glyph has place, x, y, w, h, char, conf, raw_char, raw_conf, top_k (char, conf), and its measures
(``MEASURES``) as struct f, null for glyphs merged of two.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import shapes as S
from ..functions.columns import let
from ..sources.staged import staged
from .context import bonus, corrected, step
from .lines import line_scores

MEASURES = ("aspect", "fill", "left", "right", "top", "bottom", "center", "center_row", "center_col", "diag_primary", "diag_secondary", "holes", "content_w", "content_h")
#: Shape rules that a glyph carries as flags.
FLAGS = ("minus", "slash", "slash_fragment", "open_boundary", "close_boundary", "star", "one", "strong_slash", "sure_slash", "thin_slash", "three", "sparse_seven")
ITEM = (
    "struct<place:int,x:int,y:int,w:int,h:int,char:string,conf:double,raw_char:string,raw_conf:double,top_k:array<struct<char:string,conf:double>>,adjusted:boolean,"
    f"f:struct<{','.join(f'{m}:double' for m in MEASURES)}>,s:struct<{','.join(f'{n}:boolean' for n in FLAGS)}>>"
)
FIELDS = ("place", "x", "y", "w", "h", "char", "conf", "raw_char", "raw_conf", "top_k", "adjusted", "f", "s")
OPERATORS, DIGITS = tuple("+-*/"), tuple("0123456789")
TERM_START, TERM_END = (*DIGITS, "("), (*DIGITS, ")")


def glyph(row: dict[str, Column], measures: DataFrame | None = None) -> Column:
    """A glyph's struct from columns by name; its shape flags are found here, once."""
    flags = [S.looks_like(n).alias(n) for n in FLAGS]
    own = F.struct(
        row["place"].cast("int").alias("place"), *[row[c].cast("int").alias(c) for c in "xywh"], row["char"].alias("char"), row["conf"].cast("double").alias("conf"), row["raw_char"].alias("raw_char"),
        row["raw_conf"].cast("double").alias("raw_conf"), row["top_k"].alias("top_k"), F.lit(False).alias("adjusted"), F.struct(*[F.col(m).cast("double").alias(m) for m in MEASURES]).alias("f"), F.struct(*flags).alias("s"))
    return own.cast(ITEM)


def _set(item: Column, **values: Column) -> Column:
    """The glyph with other values, as one new struct: chains of single changes make plans that grow with their square."""
    return F.struct(*[values.get(n, item[n]).alias(n) for n in FIELDS])


def median(values: Column) -> Column:
    """Null of no values."""
    s, n = F.sort_array(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def area(g: Column) -> Column:
    return (g["w"] * g["h"]).cast("double")


def center_y(g: Column) -> Column:
    return g["y"] + g["h"] / 2.0


def median_area(items: Column) -> Column:
    return median(F.transform(items, area))


def median_height(items: Column) -> Column:
    return median(F.transform(items, lambda g: g["h"].cast("double")))


def _ratio(f: Column, a: str, b: str, factor: float) -> Column:
    return f[a] >= f[b] * factor


# --- support by the model

def support(g: Column, target: str, least: float) -> Column:
    """Whether the model gave ``target`` some confidence; a glyph without a list of classes may be anything."""
    return (F.size(g["top_k"]) <= 0) | (g["raw_char"] == target) | (S.top_k_score(g["top_k"], F.lit(target)) >= least)


def listed_score(g: Column, target: str) -> Column:
    """The confidence of ``target`` in the list; without a list that of the model's own class."""
    own = F.when((F.size(g["top_k"]) <= 0) & (g["raw_char"] == target), g["raw_conf"]).otherwise(0.0)
    return F.greatest(S.top_k_score(g["top_k"], F.lit(target)), own)


def near_top(g: Column, target: str, least: float, gap: float, without_list: Column | bool = False) -> Column:
    none = F.lit(without_list) if isinstance(without_list, bool) else without_list
    return F.when(F.size(g["top_k"]) <= 0, none).otherwise((g["raw_char"] == target) | S.near_top(g["top_k"], F.lit(target), least, gap))


# --- contexts of a character: null stands for the line's end

def between_terms(before: Column, after: Column) -> Column:
    return F.coalesce(before.isin(*TERM_END) & after.isin(*TERM_START), F.lit(False))


def may_open(before: Column, after: Column) -> Column:
    return (before.isNull() | before.isin(*OPERATORS, "(")) & F.coalesce(after.isin(*TERM_START, "-"), F.lit(False))


def may_close(before: Column, after: Column) -> Column:
    return F.coalesce(before.isin(*TERM_END), F.lit(False)) & (after.isNull() | after.isin(*OPERATORS, ")"))


# --- noise

def is_noise(g: Column, ma: Column, mh: Column) -> Column:
    """Whether a glyph is a speck; a sure minus of some width never is."""
    minus = g["char"] == "-"
    sure = minus & (g["conf"] >= 0.95) & g["s"]["minus"] & (g["w"] >= F.greatest(F.lit(10.0), mh * 0.16))
    tests = [
        (g["conf"] < 0.55) & (area(g) < F.greatest(F.lit(25.0), ma * 0.1)), (area(g) < F.greatest(F.lit(120.0), ma * 0.02)) & (g["h"] < F.greatest(F.lit(14.0), mh * 0.2)),
        (g["f"]["content_h"] < 5) & (g["conf"] < 0.98), minus & (g["conf"] < 0.995) & (area(g) < F.greatest(F.lit(32.0), ma * 0.22)) & (g["h"] < F.greatest(F.lit(10.0), mh * 0.35)),
    ]
    return ~sure & reduce(lambda a, b: a | b, tests)


def edge_fragment(g: Column, ma: Column, mh: Column) -> Column:
    """A small glyph at the end of a number that looks like an operator or parenthesis."""
    small = (area(g) <= F.greatest(F.lit(180.0), ma * 0.32)) & (g["h"] <= F.greatest(F.lit(32.0), mh * 0.46))
    return small & (g["char"].isin(*OPERATORS, "(", ")") | g["s"]["minus"] | g["s"]["slash"])


def strong_operator(g: Column) -> Column:
    c, p, s = g["char"], g["conf"], g["s"]
    return (
        ((c == "*") & (p >= 0.9)) | (c.isin("+", "4") & (p >= 0.9) & s["star"]) | ((c == "-") & (p >= 0.98) & s["minus"]) | ((c == "/") & (p >= 0.8) & s["slash"])
        | (c.isin("1", "7") & (s["strong_slash"] | ((p < 0.995) & s["sure_slash"]))))


def is_numeric(items: Column) -> Column:
    """Whether a line is a number: five glyphs or more, no sure operator, at most one that is no digit, parenthesis or slash."""
    digits = F.size(F.filter(items, lambda g: g["char"].isin(*DIGITS, "(", ")", "/")))
    return (F.size(items) >= 5) & ~F.exists(items, strong_operator) & (digits >= F.size(items) - 1)


def without_edge_noise(items: Column) -> Column:
    """Fragments taken off a number's ends, the left one first, while six glyphs or more are left and the rest is a number."""
    def trimmed(all_: Column, ma: Column, mh: Column) -> Column:
        def turn(rest: Column, _: Column) -> Column:
            n = F.size(rest)
            lead, tail = F.slice(rest, 2, F.greatest(n - 1, F.lit(0))), F.slice(rest, 1, F.greatest(n - 1, F.lit(0)))
            at = lambda k: edge_fragment(F.try_element_at(rest, F.lit(k)), ma, mh)
            return F.when(n < 6, rest).when(at(1) & is_numeric(lead), lead).when(at(-1) & is_numeric(tail), tail).otherwise(rest)

        return F.aggregate(all_, all_, turn)

    return F.when(F.size(items) < 6, items).otherwise(let([items, median_area(items), median_height(items)], trimmed))


def without_edge_operators(items: Column, ma: Column, mh: Column) -> Column:
    """A line without the tiny minuses that stand far off at its ends."""
    def stray(g: Column, gap: Column) -> Column:
        return F.coalesce(g["char"].isin(*OPERATORS) & g["s"]["minus"] & (area(g) < F.greatest(F.lit(45.0), ma * 0.25)) & (gap > mh * 0.45), F.lit(False))

    def turn(rest: Column, left: bool) -> Column:
        n = F.size(rest)
        a, b = (F.try_element_at(rest, F.lit(k)) for k in ((1, 2) if left else (-2, -1)))
        gap = b["x"] - (a["x"] + a["w"])
        shorter = F.slice(rest, 2 if left else 1, F.greatest(n - 1, F.lit(0)))
        return F.when((n >= 2) & stray(a if left else b, gap), shorter).otherwise(rest)

    # a turn that takes nothing ends its side, as the next one sees the same glyphs
    once = F.aggregate(items, items, lambda rest, _: turn(rest, True))
    return F.aggregate(items, once, lambda rest, _: turn(rest, False))


# --- lines by height

def first_fit(items: Column, tolerance: Column) -> Column:
    """Groups of glyphs, from top to bottom: each joins the first group whose mean centre is near enough, else opens one."""
    ordered = F.transform(F.array_sort(F.transform(items, lambda g: F.struct(center_y(g).alias("cy"), g["place"].alias("p"), g.alias("g")))), lambda t: t["g"])
    none = F.array().cast(f"array<struct<total:double,n:int,items:array<{ITEM}>>>")

    def put(groups: Column, g: Column) -> Column:
        cy = center_y(g)
        at = F.try_element_at(F.filter(F.sequence(F.lit(1), F.greatest(F.size(groups), F.lit(1))), lambda k: F.coalesce(F.abs(cy - F.try_element_at(groups, k)["total"] / F.try_element_at(groups, k)["n"]) <= tolerance, F.lit(False))), F.lit(1))
        new = F.struct(cy.cast("double").alias("total"), F.lit(1).alias("n"), F.array(g).alias("items"))
        joined = lambda at: F.transform(groups, lambda t, k: F.when(k + 1 == at, F.struct((t["total"] + cy).alias("total"), (t["n"] + 1).alias("n"), F.concat(t["items"], F.array(g)).alias("items"))).otherwise(t))
        return let([at], lambda at: F.when(at.isNull(), F.concat(groups, F.array(new))).otherwise(joined(at)))

    return F.aggregate(ordered, none, put)


def by_x(items: Column) -> Column:
    return F.transform(F.array_sort(F.transform(items, lambda g: F.struct(g["x"].alias("x"), g["place"].alias("p"), g.alias("g")))), lambda t: t["g"])


def main_line(items: Column) -> Column:
    """The glyphs of a line's fullest row, where its large glyphs spread over several rows of three or more."""
    def chosen(all_: Column, ma: Column, mh: Column) -> Column:
        core = F.filter(all_, lambda g: area(g) >= F.greatest(F.lit(150.0), ma * 0.2))
        centers = F.transform(core, center_y)
        spread = F.array_max(centers) - F.array_min(centers)
        groups = F.filter(first_fit(core, F.greatest(F.lit(28.0), mh * 0.65)), lambda t: t["n"] >= 3)
        score = lambda t: t["n"] * 1000.0 + F.aggregate(t["items"], F.lit(0.0), lambda a, g: a + area(g)) - F.array_min(F.transform(t["items"], center_y))
        # the first of equally good rows
        best = F.get(F.array_sort(F.transform(groups, lambda t, k: F.struct((-score(t)).alias("minus"), k.alias("k"), (t["total"] / t["n"]).alias("c")))), 0)["c"]
        near = let([best], lambda c: F.filter(all_, lambda g: F.abs(center_y(g) - c) <= F.greatest(F.lit(40.0), mh * 0.85)))
        one = (F.size(core) < 3) | (spread <= F.greatest(F.lit(120.0), mh * 1.65)) | (F.size(groups) <= 1)
        return F.when(one, all_).otherwise(F.when(F.size(near) > 0, near).otherwise(all_))

    return by_x(let([items, median_area(items), median_height(items)], chosen))


# --- numbers

# Bounds and orders of both decision lists, and the scores of candidates.
#: A number's glyphs: (classes, test of measures f and flags s, class), first match first. Classes None: any.
NUMBER_RULES: list[tuple[str | None, Callable[[Column, Column], Column], str]] = [
    ("/()", lambda f, s: s["one"] & ~(s["open_boundary"] | s["close_boundary"]), "1"),
    ("-", lambda f, s: s["sparse_seven"], "7"),
    ("7", lambda f, s: (f["holes"] == 0) & (f["aspect"] <= 0.55) & _ratio(f, "right", "left", 1.80) & (f["center"] >= 0.35) & (f["center_row"] >= 0.28) & (f["center_col"] <= 0.35), "1"),
    ("1", lambda f, s: (f["holes"] == 0) & (f["aspect"] <= 0.55) & _ratio(f, "left", "right", 2.20) & (f["center"] <= 0.10) & (f["center_col"] <= 0.30) & _ratio(f, "bottom", "top", 0.90), "6"),
    ("72", lambda f, s: s["three"], "3"),
    ("5", lambda f, s: (f["holes"] == 0) & (f["aspect"] >= 0.68) & _ratio(f, "left", "right", 1.35) & (f["top"] <= 0.24) & _ratio(f, "bottom", "top", 1.75) & (f["center"] >= 0.24) & (f["center_col"] <= 0.36), "6"),
    ("6", lambda f, s: _ratio(f, "left", "right", 1.08), "6"),
    ("9", lambda f, s: _ratio(f, "right", "left", 1.08), "9"),
    (None, lambda f, s: f["holes"] >= 2, "8"),
    ("70)", lambda f, s: (f["holes"] == 1) & (f["center"] >= 0.18) & _ratio(f, "right", "left", 1.2) & _ratio(f, "top", "bottom", 0.95), "9"),
    ("/", lambda f, s: (f["holes"] == 0) & (f["aspect"] <= 0.62) & (f["content_w"] <= 10), "1"),
    ("/", lambda f, s: (f["aspect"] >= 0.75) & (f["bottom"] > f["top"] * 1.12), "2"),
    ("/", lambda f, s: f["aspect"] >= 0.75, "3"),
    ("()6", lambda f, s: _ratio(f, "left", "right", 1.15), "6"),
    ("()6", lambda f, s: _ratio(f, "right", "left", 1.15) & (f["center"] >= 0.18), "9"),
]


def number_char(g: Column) -> Column:
    """What a glyph is in a number."""
    out = F.when(F.lit(False), g["char"])
    for chars, test, char in NUMBER_RULES:
        own = test(g["f"], g["s"])
        out = out.when(own if chars is None else g["char"].isin(*chars) & own, char)
    return out.otherwise(g["char"])


def pair_char(f: Column) -> Column:
    """The digit that two halves make up, by the measures of both together; null if none."""
    one = f["holes"] == 1
    nine = f["aspect"].between(0.34, 0.60) & _ratio(f, "right", "left", 1.60) & (f["center"] <= 0.16) & (f["center_col"] <= 0.15) & _ratio(f, "diag_primary", "diag_secondary", 2.20)
    return (
        F.when(f["holes"] >= 2, "8").when(one & _ratio(f, "right", "left", 1.15) & (f["center"] >= 0.14), "9").when(one & _ratio(f, "left", "right", 1.15) & (f["center"] <= 0.12), "6").when(one, "0").when(nine, "9"))


def is_half(g: Column, mh: Column) -> Column:
    slender = g["raw_char"].isin("1", "7", "/", "\\", "(", ")") | (g["w"] <= F.greatest(F.lit(36.0), mh * 0.40)) | (g["f"]["aspect"] <= 0.42)
    return (g["h"] <= F.greatest(F.lit(84.0), mh * 0.92)) & slender


def _joined(a: Column, b: Column, char: Column, **more: Column) -> Column:
    """Two glyphs as one with the box of both; it has no measures unless ``more`` gives some."""
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    best = lambda c: F.greatest(a[c], b[c])
    values = {
        "x": x, "y": y, "w": F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - x, "h": F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - y, "char": char, "conf": best("conf"), "raw_char": F.concat(a["char"], b["char"]), "raw_conf": best("conf"),
        "top_k": F.array().cast("array<struct<char:string,conf:double>>"), "adjusted": F.lit(True), "f": F.lit(None), "s": F.lit(None)} | more
    return _set(a, **values).cast(ITEM)


def folded_pairs(items: Column, fits: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """Glyphs with neighbours merged from left to right; a merged pair is passed over. ``fits`` gives the merged glyph or
    null for (left, right, character before, character after), both as they stand in the list."""
    n = F.size(items)
    start = F.struct(F.array().cast(f"array<{ITEM}>").alias("out"), F.lit(1).alias("at"))

    def turn(state: Column, _: Column) -> Column:
        k = state["at"]
        here = lambda d: F.try_element_at(items, k + d)
        before = F.when(k > 1, F.try_element_at(items, F.greatest(k - 1, F.lit(1)))["char"])
        one = let([here(0), here(1)], lambda a, b: F.when(b.isNotNull(), fits(a, b, before, here(2)["char"])))
        return let([one, here(0)], lambda m, a: F.when(k > n, state).otherwise(F.struct(F.concat(state["out"], F.array(F.coalesce(m, a))).alias("out"), F.when(m.isNull(), k + 1).otherwise(k + 2).cast("int").alias("at"))))

    return F.aggregate(items, start, turn, lambda s: s["out"])


def merged_halves(items: Column, together: Column, mh: Column) -> Column:
    """Halves of digits in a number merged. ``together``: (left, right, f) measures of neighbouring glyphs as one picture, by place."""
    def fits(a: Column, b: Column, before: Column, after: Column) -> Column:
        gap = F.greatest(F.lit(0), b["x"] - (a["x"] + a["w"]))
        over = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
        wide = F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - F.least(a["x"], b["x"])
        high = F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - F.least(a["y"], b["y"])
        near = is_half(a, mh) & is_half(b, mh) & (gap <= F.greatest(F.lit(8.0), mh * 0.18)) & (over >= F.least(a["h"], b["h"]) * 0.32) & (wide <= F.greatest(F.lit(60.0), mh * 0.72)) & (wide / F.greatest(F.lit(1), high) <= 1.15)
        f = F.try_element_at(F.filter(together, lambda t: (t["left"] == a["place"]) & (t["right"] == b["place"])), F.lit(1))["f"]
        flags = F.struct(*[F.lit(False).alias(n) for n in FLAGS])  # the rules of numbers that follow look at the class first
        best = F.greatest(a["raw_conf"], b["raw_conf"])
        return F.when(near, let([f], lambda m: F.when(pair_char(m).isNotNull(), _joined(a, b, pair_char(m), f=m, s=flags, raw_char=F.concat(a["raw_char"], b["raw_char"]), raw_conf=best))))

    return folded_pairs(items, fits)


# --- expressions

def as_slash(a: Column, b: Column, before: Column, after: Column, mh: Column) -> Column:
    """Two strokes that rise to the right, between terms, are one slash."""
    stroke = lambda g: g["s"]["slash"] | g["s"]["slash_fragment"]
    gap = F.greatest(F.lit(0), b["x"] - (a["x"] + a["w"]))
    wide = F.greatest(a["x"] + a["w"], b["x"] + b["w"]) - F.least(a["x"], b["x"])
    high = F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - F.least(a["y"], b["y"])
    rises = (b["x"] + b["w"] / 2.0 > a["x"] + a["w"] / 2.0) & (center_y(b) < center_y(a))
    chars = lambda g: g["char"].isin("1", "-", "/", "(", ")")
    fits = between_terms(before, after) & chars(a) & chars(b) & stroke(a) & stroke(b) & (gap <= F.greatest(F.lit(4.0), mh * 0.08)) & rises
    return F.coalesce(fits & (wide <= F.greatest(F.lit(120.0), mh * 2.40)) & (high <= F.greatest(F.lit(140.0), mh * 2.80)), F.lit(False))


def as_star(a: Column, b: Column, before: Column, after: Column, mh: Column) -> Column:
    """Two strokes that touch or stand on one another, between terms, are one star."""
    gap = b["x"] - (a["x"] + a["w"])
    over_x = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    over_y = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    ratio = (b["x"] + b["w"] - a["x"]) / F.greatest(F.lit(1), F.greatest(a["y"] + a["h"], b["y"] + b["h"]) - F.least(a["y"], b["y"]))
    touch = (gap <= F.greatest(F.lit(6.0), mh * 0.12)) & (over_x >= -F.greatest(F.lit(6.0), mh * 0.05)) & (over_y >= F.least(a["h"], b["h"]) * 0.45) & ratio.between(0.45, 1.2)
    stand = (F.abs(a["x"] + a["w"] / 2.0 - b["x"] - b["w"] / 2.0) <= F.greatest(F.lit(8.0), mh * 0.20)) & (F.greatest(F.lit(0), -over_y) <= F.greatest(F.lit(10.0), mh * 0.22)) & (over_x >= F.least(a["w"], b["w"]) * 0.28) & ratio.between(0.45, 1.15)
    chars = lambda g: g["char"].isin("(", ")", "1", "/", "4", "7", "+", "*")
    return F.coalesce(between_terms(before, after) & chars(a) & chars(b) & (touch | stand), F.lit(False))


def merged_strokes(items: Column, mh: Column) -> Column:
    def fits(a: Column, b: Column, before: Column, after: Column) -> Column:
        return F.when(as_slash(a, b, before, after, mh), _joined(a, b, F.lit("/"))).when(as_star(a, b, before, after, mh), _joined(a, b, F.lit("*")))

    return folded_pairs(items, fits)


#: An expression's glyphs: (classes, test of the glyph and the characters around it, class), first match first.
EXPRESSION_RULES: list[tuple[str, Callable[[Column, Column, Column], Column], str]] = [
    ("1/()", lambda g, b, a: g["s"]["one"] & ~g["s"]["open_boundary"] & ~g["s"]["close_boundary"] & ~g["s"]["slash"], "1"),
    ("+", lambda g, b, a: between_terms(b, a) & near_top(g, "*", 0.25, 0.20) & (g["f"]["center"] >= 0.48) & (g["f"]["diag_primary"] >= 0.52) & (g["f"]["diag_secondary"] >= 0.52) & (F.abs(g["f"]["diag_primary"] - g["f"]["diag_secondary"]) <= 0.32), "*"),
    ("17-()", lambda g, b, a: g["s"]["slash"] & between_terms(b, a) & ~g["s"]["one"], "/"),
    ("4*+", lambda g, b, a: g["s"]["star"] & between_terms(b, a), "*"),
    ("/()", lambda g, b, a: g["s"]["slash"] & between_terms(b, a), "/"),
    ("17/()", lambda g, b, a: g["s"]["slash"] & near_top(g, "/", 0.25, 0.08) & between_terms(b, a), "/"),
    ("17()", lambda g, b, a: (g["s"]["thin_slash"] | g["s"]["strong_slash"] | ((g["conf"] < 0.995) & g["s"]["sure_slash"])) & between_terms(b, a), "/"),
    ("()1/", lambda g, b, a: g["s"]["open_boundary"] & ~g["s"]["one"] & support(g, "(", 0.07) & may_open(b, a), "("),
    ("()17/", lambda g, b, a: g["s"]["close_boundary"] & ~g["s"]["one"] & support(g, ")", 0.08) & may_close(b, a), ")"),
]


def expression_char(g: Column, before: Column, after: Column) -> Column:
    """What a glyph is between the characters around it; one without measures stays what it is."""
    out = F.when(g["f"].isNull(), g["char"])
    for chars, test, char in EXPRESSION_RULES:
        out = out.when(g["char"].isin(*chars) & test(g, before, after), char)
    return out.otherwise(g["char"])


def _recoded(g: Column, char: Column) -> Column:
    return let([g, char], lambda i, c: F.when(c == i["char"], i).otherwise(_set(i, char=c, adjusted=F.lit(True)).cast(ITEM)))


def overridden(items: Column) -> Column:
    """Each glyph in the light of the character decided before it and of the one that follows as it is: a fold."""
    def turn(out: Column, g: Column, k: Column) -> Column:
        before, after = F.try_element_at(out, F.lit(-1))["char"], F.try_element_at(items, k + 2)["char"]
        return F.concat(out, F.array(_recoded(g, expression_char(g, before, after))))

    numbered = F.transform(items, lambda g, k: F.struct(g.alias("g"), k.alias("k")))
    return F.aggregate(numbered, F.array().cast(f"array<{ITEM}>"), lambda out, t: turn(out, t["g"], t["k"]))


def candidates(g: Column) -> Column:
    """array of (char, score): the glyph's class first, then what its shape may be, each class with its best score."""
    c, s = g["char"], g["s"]
    near, listed = near_top(g, "/", 0.25, 0.08), listed_score(g, "/")
    among = lambda chars: c.isin(*chars)
    best = lambda plain, close: F.when(near, F.greatest(plain, close)).otherwise(plain)
    slash = (
        F.when(s["strong_slash"], best(F.when(among("17/)("), 0.98).otherwise(0.92), F.when(among("17/"), 1.02).otherwise(0.94)))
        .when(s["sure_slash"], best(F.when(among("17/)("), 0.92).otherwise(0.86), F.when(among("17/"), 0.98).otherwise(0.90)))
        .when(s["slash"], F.when(near, F.when(among("17/"), 1.00).otherwise(0.90)).when(listed >= 0.10, F.greatest(F.lit(0.80), 0.72 + listed)).otherwise(0.80)))
    no_one = ~s["one"]
    plain_one = F.when(among("1/()"), 0.87).otherwise(0.80)
    one = F.when(near_top(g, "1", 0.18, 0.16, c == "1"), F.greatest(plain_one, F.when(among("/()"), 0.96).otherwise(0.90))).otherwise(plain_one)
    found = [
        (c, g["conf"] + 0.55), (F.lit("-"), F.when(s["minus"], 0.84)), (F.lit("*"), F.when(s["star"], F.when(among("*+4"), 0.90).otherwise(0.86))), (F.lit("/"), slash),
        (F.lit("("), F.when(s["open_boundary"] & no_one & support(g, "(", 0.07), F.when(among("()1/6"), 0.83).otherwise(0.78))),
        (F.lit(")"), F.when(s["close_boundary"] & no_one & support(g, ")", 0.08), F.when(among("()1/7"), 0.83).otherwise(0.78))),
        (F.lit("1"), F.when(s["one"] & ~(s["open_boundary"] | s["close_boundary"]), one)),
    ]
    return F.filter(F.array(*[F.struct(char.alias("char"), score.cast("double").alias("score")) for char, score in found]), lambda t: t["score"].isNotNull())


def best_expression(chars: list[str], conf: list[float], options: list[list[tuple[str, float]]], width: int = 64, gain: float = 0.20) -> list[str]:
    """The best-scored whole expression that takes one option a glyph, by beam search over (open parentheses, term
    expected, last character); the characters as they are if there is none or it is not better by ``gain``."""
    if len(chars) <= 1:
        return chars
    beam: dict[tuple, tuple[float, list[str]]] = {(0, True, ""): (0.0, [])}
    for place in options:
        own: dict[str, float] = {}
        for char, score in place:
            own[char] = max(score, own.get(char, score))
        grown: dict[tuple, tuple[float, list[str]]] = {}
        for (depth, term, last), (total, text) in beam.items():
            for char, score in own.items():
                if char not in "0123456789+-*/()" or (new := step((depth, term), char)) is None:
                    continue
                key, sum_ = (*new, char), total + score + bonus(last, char)
                if key not in grown or sum_ > grown[key][0]:
                    grown[key] = (sum_, [*text, char])
        if not grown:
            return chars
        beam = dict(sorted(grown.items(), key=lambda kv: -kv[1][0])[:width])
    whole = [v for (depth, term, _), v in beam.items() if depth == 0 and not term]
    if not whole:
        return chars
    best = max(whole, key=lambda v: v[0])
    state, total, last = (0, True), 0.0, ""
    for char, p in zip(chars, conf):
        state = step(state, char) if char in "0123456789+-*/()" else None
        if state is None:
            return best[1]
        total += p + 0.55 + bonus(last, char)
        last = char
    return chars if state == (0, False) and best[0] < total + gain else best[1]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _best_expressions(asked: pd.DataFrame) -> pd.Series:
    """``best_expression`` of rows (chars, conf, options)."""
    return pd.Series([best_expression(list(c), list(p), [[(t["char"], t["score"]) for t in place["o"]] for place in o]) for c, p, o in zip(asked["chars"], asked["conf"], asked["options"])])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("char", T.StringType()), T.StructField("conf", T.DoubleType())])))
def _corrected(chars: pd.Series, conf: pd.Series) -> pd.Series:
    return pd.Series([[{"char": a, "conf": b} for a, b in zip(*corrected(list(c), list(p)))] for c, p in zip(chars, conf)])


# so that no plan moves them into a list function, where Python can't run
_best_expressions, _corrected = _best_expressions.asNondeterministic(), _corrected.asNondeterministic()


# --- whole lines

def chained(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """The steps one after the other, each on what the plan holds once: inlined columns would grow without bound."""
    return chained(let([value], steps[0]), *steps[1:]) if steps else value


def _prepared(items: Column, together: Column) -> Column:
    """struct(items, numeric, asked): a line up to the choice of a whole expression, and what that choice needs."""
    quiet = lambda i: let([i, median_area(i), median_height(i)], lambda all_, ma, mh: F.filter(all_, lambda g: ~F.coalesce(is_noise(g, ma, mh), F.lit(False))))

    def read(i: Column, ma: Column, mh: Column, numeric: Column) -> Column:
        joined = let([F.when(numeric, merged_halves(i, together, mh)).otherwise(merged_strokes(i, mh))], lambda m: F.when(numeric, F.transform(m, lambda g: _recoded(g, number_char(g)))).otherwise(overridden(m)))
        kept = let([joined], lambda m: F.when(numeric, m).otherwise(without_edge_operators(m, ma, mh)))
        return let([kept, numeric], asked)

    def asked(i: Column, numeric: Column) -> Column:
        alone = let([i], lambda x: F.when(numeric | (F.size(x) <= 1), F.array().cast(f"array<{ITEM}>")).otherwise(x))
        plain = lambda g: F.array(F.struct(g["char"].alias("char"), (g["conf"] + 0.55).alias("score")))
        options = lambda x: F.transform(x, lambda g: F.struct(F.when(g["f"].isNull(), plain(g)).otherwise(candidates(g)).alias("o")))
        ask = let([alone], lambda x: F.struct(F.transform(x, lambda g: g["char"]).alias("chars"), F.transform(x, lambda g: g["conf"]).alias("conf"), options(x).alias("options")))
        return F.struct(i.alias("items"), numeric.alias("numeric"), ask.alias("asked"))

    last = lambda i: let([i, median_area(i), median_height(i), is_numeric(i)], read)
    return chained(items, main_line, quiet, without_edge_noise, last)


def refine(lines: DataFrame) -> DataFrame:
    """``lines`` (items, together) with refined items and numeric: what a line of glyphs says."""
    d = lines.withColumn("p", _prepared(F.col("items"), F.col("together")))
    d = d.withColumn("best", _best_expressions(F.col("p.asked")))
    pick = lambda best: lambda g, k: let([F.when(F.size(best) > 0, _recoded(g, F.try_element_at(best, k + 1))).otherwise(g)], lambda i: _set(i, conf=F.bround(i["conf"], 3), raw_conf=F.bround(i["raw_conf"], 3)).cast(ITEM))
    return d.withColumn("items", let([F.col("p.items"), F.col("best")], lambda i, best: F.transform(i, pick(best)))).withColumn("numeric", F.col("p.numeric")).drop("p", "best")


def in_context(lines: DataFrame) -> DataFrame:
    """``lines`` with unsure operators read as digits where two meet, or at the ends."""
    items = F.col("items")
    d = lines.withColumn("c", _corrected(F.transform(items, lambda g: g["char"]), F.transform(items, lambda g: g["conf"])))
    new = F.transform(items, lambda g, k: _set(g, char=F.try_element_at(F.col("c"), k + 1)["char"], conf=F.try_element_at(F.col("c"), k + 1)["conf"]).cast(ITEM))
    return d.withColumn("items", new).drop("c")


def refine_images(glyphs: DataFrame, together: DataFrame | None = None) -> DataFrame:
    """(image_id, line, items, numeric): the lines of each image's glyphs (image_id, item), from top to bottom.

    Lines are found by first fit; small ones go, each is corrected in context and refined, and lines that score
    far less than the best one go as well. together: (image_id, left, right, f)."""
    g = glyphs.groupBy("image_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    if together is None:
        g = g.withColumn("together", F.array().cast(f"array<struct<left:int,right:int,f:struct<{','.join(f'{m}:double' for m in MEASURES)}>>>"))
    else:
        g = g.join(together.groupBy("image_id").agg(F.collect_list(F.struct("left", "right", "f")).alias("together")), "image_id", "left")
    area_of = lambda items: F.aggregate(items, F.lit(0.0), lambda a, i: a + area(i))
    top = lambda t: F.array_min(F.transform(t, lambda i: i["y"]))

    def ordered(groups: Column, items: Column) -> Column:
        """The large groups from top to bottom; a single one stays in the order of its glyphs until it is refined."""
        large = let([F.array_max(F.transform(groups, area_of))], lambda most: F.filter(groups, lambda t: (area_of(t) >= most * 0.08) | (F.size(t) >= 3)))
        some = let([large], lambda n: F.when(F.size(n) > 0, n).otherwise(groups))
        down = F.transform(F.array_sort(F.transform(some, lambda t, k: F.struct(top(t).alias("top"), k.alias("k"), t.alias("t")))), lambda s: by_x(s["t"]))
        return F.when(F.size(groups) == 1, F.array(items)).otherwise(down)

    found = let([F.col("items")], lambda i: F.transform(first_fit(i, F.greatest(F.lit(60.0), median_height(i) * 1.25)), lambda t: t["items"]))
    each = g.select("image_id", "together", F.posexplode(let([found, F.col("items")], ordered)).alias("line", "items"))
    source = each.withColumn("source", F.col("items"))
    done = staged(refine(in_context(source)).filter(F.size("items") > 0), "refined")  # read for the scores too
    score = scored_lines(done)
    by_image = Window.partitionBy("image_id")
    kept = score.withColumn("best", F.max("score").over(by_image)).withColumn("n_lines", F.count("*").over(by_image))
    enough = F.col("score") >= F.greatest(F.lit(4.0), F.col("best") * 0.42)
    kept = kept.withColumn("any", F.max(enough).over(by_image)).filter((F.col("n_lines") == 1) | enough | ~F.col("any"))
    order = F.row_number().over(by_image.orderBy("line")) - 1
    return kept.withColumn("line", order.cast("int")).select("image_id", "line", "items", "numeric", F.round("score", 6).alias("score"))


def scored_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (image_id, line, items, source) with score, by the rule of ``line_scores``; a line's area is that of its glyphs before refinement."""
    rows = lines.select("image_id", "line", F.explode("items").alias("g"), F.aggregate("source", F.lit(0.0), lambda a, i: a + area(i)).alias("source_area"))
    flat = rows.select("image_id", "line", "source_area", *[F.col(f"g.{c}").alias(c) for c in ("char", "conf", "x", "y", "w", "h")])
    return lines.join(line_scores(flat, "source_area").select("image_id", "line", "score"), ["image_id", "line"])
