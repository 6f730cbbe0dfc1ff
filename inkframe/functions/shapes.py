"""What a glyph's measured shape looks like: rules as bounds on features, as column expressions.

A rule holds if every named feature lies in its bounds. Features beside those of the feature
record: ``margin`` (secondary less primary diagonal), ``abs_margin``, ``balance`` (the larger side
half over the smaller), ``tilt`` (difference of the side halves), and ratios ``a/b`` of features.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY = None
# Lower and upper bound of each feature that a rule looks at.
RULES: dict[str, dict[str, tuple[float | None, float | None]]] = {
    "minus": {"aspect": (2.0, ANY), "content_h": (ANY, 6), "center_row": (0.45, ANY)},
    "slash": {"holes": (0, 0), "content_h": (12, ANY), "aspect": (ANY, 1.05), "fill": (ANY, 0.42), "center": (ANY, 0.78), "center_col": (ANY, 0.52), "diag_secondary": (0.72, ANY), "margin": (0.42, ANY)},
    "slash_fragment": {"holes": (0, 0), "fill": (0.15, 0.30), "center": (0.42, 0.62), "center_row": (ANY, 0.30), "center_col": (ANY, 0.32), "diag_secondary": (0.72, ANY), "margin": (0.62, ANY), "diag_primary": (ANY, 0.12)},
    "left_paren": {"holes": (0, 0), "content_h": (14, ANY), "aspect": (ANY, 0.65), "fill": (0.25, 0.78), "center": (0.35, ANY), "center_row": (0.42, ANY), "center_col": (0.42, 0.90), "left/right": (1.35, ANY)},
    "right_paren": {"holes": (0, 0), "content_h": (14, ANY), "aspect": (ANY, 0.65), "fill": (0.25, 0.78), "center": (0.35, ANY), "center_row": (0.42, ANY), "center_col": (0.42, 0.90), "right/left": (1.35, ANY)},
    "open_bracket": {"holes": (0, 0), "content_h": (14, ANY), "aspect": (ANY, 0.42), "fill": (0.24, 0.72), "center": (ANY, 0.12), "center_row": (ANY, 0.38), "center_col": (ANY, 0.36), "top": (0.22, ANY), "bottom": (0.22, ANY), "left/right": (2.10, ANY)},
    "drawn_open": {"holes": (0, 0), "content_h": (14, ANY), "aspect": (ANY, 0.40), "fill": (0.34, 0.62), "center": (ANY, 0.36), "center_row": (ANY, 0.43), "center_col": (ANY, 0.55), "top": (0.34, ANY), "bottom": (0.34, ANY), "left/right": (1.75, ANY)},
    "close_bracket": {"holes": (0, 0), "content_h": (14, ANY), "aspect": (ANY, 0.42), "fill": (0.24, 0.72), "center": (ANY, 0.12), "center_row": (ANY, 0.38), "center_col": (0.48, ANY), "top": (0.22, ANY), "bottom": (0.22, ANY), "right/left": (2.10, ANY)},
    "star": {"holes": (0, 0), "aspect": (0.75, 1.2), "fill": (0.45, ANY), "center": (0.75, ANY), "diag_primary": (1.15, ANY), "diag_secondary": (1.15, ANY), "abs_margin": (ANY, 0.2)},
    "straight_one": {"holes": (0, 0), "content_h": (14, ANY), "aspect": (ANY, 0.9), "fill": (0.28, ANY), "center": (0.45, ANY), "center_col": (0.5, ANY), "content_w": (6, ANY), "balance": (ANY, 2.1)},
    "slanted_one": {"holes": (0, 0), "content_h": (18, ANY), "aspect": (ANY, 0.60), "fill": (0.20, 0.46), "center": (0.24, 0.72), "center_row": (0.30, ANY), "center_col": (ANY, 0.40), "content_w": (ANY, 12), "balance": (1.65, ANY), "abs_margin": (0.55, ANY)},
    "three": {"holes": (ANY, 1), "aspect": (0.70, 1.00), "center": (ANY, 0.18), "center_row": (0.16, ANY), "center_col": (ANY, 0.24), "right/left": (1.25, ANY), "bottom/top": (0.95, ANY)},
    "sparse_seven": {"holes": (0, 0), "aspect": (0.30, 0.58), "fill": (0.08, 0.20), "top": (0.18, ANY), "bottom": (ANY, 0.06), "center": (ANY, 0.06), "center_col": (ANY, 0.22)},
    "sure_slash": {"aspect": (0.65, 1.0), "fill": (ANY, 0.36), "center": (ANY, 0.70), "center_col": (ANY, 0.40), "center_row": (ANY, 0.58), "diag_secondary": (0.82, ANY), "margin": (0.52, ANY), "holes": (0, 0), "content_h": (12, ANY)},
    "strong_slash": {"aspect": (0.72, 0.9), "holes": (0, 0), "fill": (ANY, 0.31), "center": (ANY, 0.57), "center_row": (ANY, 0.30), "center_col": (ANY, 0.36), "diag_secondary": (0.94, ANY), "margin": (0.68, ANY)},
    "thin_slash": {"holes": (0, 0), "aspect": (0.30, 0.55), "fill": (ANY, 0.32), "center_row": (ANY, 0.34), "center_col": (ANY, 0.36), "tilt": (ANY, 0.08), "diag_secondary": (1.00, ANY), "margin": (0.75, ANY)},
}
UNIONS = {"open_boundary": ("left_paren", "open_bracket", "drawn_open"), "close_boundary": ("right_paren", "close_bracket"), "one": ("straight_one", "slanted_one")}


def _bounds(name: str, low: float | None, high: float | None) -> list[str]:
    """SQL tests of one feature; ratios are tested by multiplication, as their divisor may be 0."""
    if "/" in name:
        a, b = name.split("/")
        return [f'"{a}" >= "{b}" * {low!r}'] if low is not None else []
    value = {"margin": '("diag_secondary" - "diag_primary")', "abs_margin": 'abs("diag_secondary" - "diag_primary")', "tilt": 'abs("left" - "right")', "balance": '(greatest("left", "right", 1e-6) / greatest(least("left", "right"), 1e-6))'}.get(name, f'"{name}"')
    return ([f"{value} >= {low!r}"] if low is not None else []) + ([f"{value} <= {high!r}"] if high is not None else [])


def rule_sql(name: str) -> str:
    """A rule as an SQL condition on feature columns in double quotes."""
    if name in UNIONS:
        return "(" + " OR ".join(rule_sql(n) for n in UNIONS[name]) + ")"
    return "(" + " AND ".join(t for f, (lo, hi) in RULES[name].items() for t in _bounds(f, lo, hi)) + ")"


def looks_like(name: str) -> Column:
    return F.expr(rule_sql(name).replace('"', "`"))


def names() -> list[str]:
    return [*RULES, *UNIONS]


def drop_noise(conf: Column, char: Column, median_area: Column, median_height: Column) -> Column:
    """Whether a glyph is a speck; a sure minus of some width never is."""
    area, w, h, content = F.col("rect_area"), F.col("rect_w"), F.col("rect_h"), F.col("content_h")
    minus = char == "-"
    sure = minus & (conf >= 0.95) & looks_like("minus") & (w >= F.greatest(F.lit(10.0), median_height * 0.16))
    tests = [
        (conf < 0.55) & (area < F.greatest(F.lit(25.0), median_area * 0.1)),
        (area < F.greatest(F.lit(120.0), median_area * 0.02)) & (h < F.greatest(F.lit(14.0), median_height * 0.2)),
        (content < 5) & (conf < 0.98),
        minus & (conf < 0.995) & (area < F.greatest(F.lit(32.0), median_area * 0.22)) & (h < F.greatest(F.lit(10.0), median_height * 0.35)),
    ]
    return ~sure & reduce(lambda a, b: a | b, tests)


def top_k_score(top_k: Column, target: Column) -> Column:
    """The confidence of ``target`` in a list of (char, conf), else 0."""
    hit = F.filter(top_k, lambda t: t["char"] == target)
    return F.coalesce(F.try_element_at(hit, F.lit(1))["conf"], F.lit(0.0))


def near_top(top_k: Column, target: Column, least: float = 0.25, gap: float = 0.08) -> Column:
    """Whether ``target`` is confident and close to the best of the list; an empty list says no."""
    own, best = top_k_score(top_k, target), F.array_max(F.transform(top_k, lambda t: t["conf"]))
    return F.coalesce((own >= least) & (best - own <= gap), F.lit(False))
