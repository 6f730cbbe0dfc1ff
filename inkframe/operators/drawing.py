"""Training pictures of operators and parentheses, drawn as pixel rows: strokes by distance, turned, with noise.

What is random comes from a digest of seed, symbol, number and name, so a picture is the same on every run and
executor, and any part of the set can be made alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of each symbol: largest shift of the centre (x, y), sizes, strokes' widths, largest angle, spread of the noise.
SYMBOLS: dict[str, tuple[int, int, tuple[int, int], tuple[int, int], float, float]] = {
    "+": (2, 2, (10, 17), (1, 3), 10.0, 7.0), "-": (2, 1, (10, 17), (1, 2), 4.0, 5.0), "*": (2, 2, (10, 16), (1, 2), 8.0, 6.0),
    "/": (1, 1, (13, 18), (1, 2), 5.0, 4.0), "(": (1, 2, (14, 18), (1, 2), 6.0, 4.0), ")": (1, 2, (14, 18), (1, 2), 6.0, 4.0),
}
SIDE, MIDDLE, LIGHTER = 28, 14, 10


def uniform(name: str | Column, *key: Column, part: int = 0) -> Column:
    """A number from 0 up to 1 by the digest of the key and a name."""
    own = F.lit(name) if isinstance(name, str) else name
    digits = F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key], own)), 8 * part + 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 4294967296.0


def parameters(numbers: DataFrame, seed: str = "42") -> DataFrame:
    """(symbol, number, cx, cy, size, thickness, angle, noise, shift): how a picture of each symbol is drawn for each of ``numbers`` (number)."""
    fields = lambda s, dx, dy, size, wide, turn, noise: F.struct(*[F.lit(v).alias(k) for k, v in zip(("symbol", "dx", "dy", "s0", "s1", "t0", "t1", "turn", "noise"), (s, dx, dy, *size, *wide, turn, noise))])
    each = numbers.select("number", F.explode(F.array(*[fields(s, *how) for s, how in SYMBOLS.items()])).alias("of")).select("number", "of.*")
    u = lambda name: uniform(name, F.lit(seed), F.col("symbol"), F.col("number"))
    whole = lambda name, lo, hi: (lo + F.floor(u(name) * (hi - lo + 1))).cast("int").alias(name)
    c = F.col
    return each.select(
        "symbol", "number", whole("cx", MIDDLE - c("dx"), MIDDLE + c("dx")), whole("cy", MIDDLE - c("dy"), MIDDLE + c("dy")), whole("size", c("s0"), c("s1")), whole("thickness", c("t0"), c("t1")),
        ((u("angle") * 2 - 1) * c("turn")).alias("angle"), "noise", whole("shift", F.lit(-LIGHTER), F.lit(LIGHTER)))


def _near(u: Column, v: Column, a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Distance of a place to the stroke from a to b."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    along = ((u - a[0]) * dx + (v - a[1]) * dy) / F.greatest(F.lit(1), dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.sqrt(F.pow(u - a[0] - t * dx, F.lit(2.0)) + F.pow(v - a[1] - t * dy, F.lit(2.0)))


def drawn(params: DataFrame, seed: str = "42") -> DataFrame:
    """(symbol, number, y, x, v): the pictures of ``parameters`` as pixel rows, light on dark."""
    p = params.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)))).withColumns({"y": F.floor(F.col("at") / SIDE).cast("int"), "x": (F.col("at") % SIDE).cast("int")})
    turn, c = F.radians("angle"), F.col
    dx, dy = c("x") - MIDDLE, c("y") - MIDDLE
    p = p.withColumns({"u": MIDDLE + dx * F.cos(turn) - dy * F.sin(turn), "w": MIDDLE + dx * F.sin(turn) + dy * F.cos(turn), "arm": F.floor(c("size") / 2)})
    cx, cy, arm = c("cx"), c("cy"), c("arm")
    stroke = lambda x0, y0, x1, y1: _near(c("u"), c("w"), (cx + x0, cy + y0), (cx + x1, cy + y1))
    level, upright, falling, rising = stroke(-arm, 0, arm, 0), stroke(F.lit(0), -arm, F.lit(0), arm), stroke(-arm, -arm, arm, arm), stroke(-arm, arm, arm, -arm)
    a, b = F.greatest(F.lit(2), F.floor(c("size") / 6)), F.greatest(F.lit(7), arm)
    side = F.when(c("symbol") == "(", -1).otherwise(1)  # the arc bends to this side of its middle, which lies one pixel to the other
    across = (c("u") - (cx - side)) * side
    ring = F.abs(F.sqrt(F.pow(across / a, F.lit(2.0)) + F.pow((c("w") - cy) / b, F.lit(2.0))) - 1) * a
    arc = F.when(across >= -0.21 * a, ring).otherwise(99.0)
    distance = F.when(c("symbol") == "+", F.least(level, upright)).when(c("symbol") == "-", level).when(c("symbol") == "*", F.least(falling, rising)).when(c("symbol") == "/", rising).otherwise(arc)
    key = [F.lit(seed), c("symbol"), c("number"), c("at")]
    normal = F.sqrt(-2.0 * F.log(F.greatest(uniform("noise", *key), F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * uniform("noise", *key, part=1))
    clip = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), v))
    ink = F.when(distance <= F.greatest(F.lit(0.7), c("thickness") / 2), 255).otherwise(0)
    return p.select("symbol", "number", "y", "x", clip(clip(F.floor(ink + normal * c("noise")).cast("int")) + c("shift")).cast("int").alias("v"))
