"""Character sequences in context: types, flips, grammar and the best consistent reading.

The left-to-right passes depend on what they have already changed, so a sequence is one fold.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import char_type

# Below this confidence an operator may be read as the digit it looks like.
THRESHOLD = 0.82
FLIPS = {"-": "1", "/": "7", "+": "4", "×": "8", "÷": "9"}
KEPT = 0.95
_OPERATORS = set("+-*/×÷=")

def _line():
    return Window.partitionBy("image_id").orderBy("place")


def leading(seq: DataFrame) -> DataFrame:
    """First characters, an unsure operator read as a digit."""
    flip = F.create_map(*[F.lit(x) for kv in FLIPS.items() for x in kv])
    first = seq.withColumn("k", F.row_number().over(_line())).filter("k = 1")
    new = F.when((char_type(F.col("char")) == "operator") & (F.col("conf") < THRESHOLD), F.try_element_at(flip, F.col("char")))
    return first.select("image_id", "char", F.coalesce(new, F.col("char")).alias("corrected"))


def double_operators(seq: DataFrame) -> DataFrame:
    """Neighbouring operators: (image_id, place, left, right, weaker place)."""
    typed = seq.withColumn("t", char_type(F.col("char")))
    pair = typed.withColumns({"prev": F.lag("char").over(_line()), "pt": F.lag("t").over(_line()), "pc": F.lag("conf").over(_line())}).filter("t = 'operator' and pt = 'operator'")
    return pair.select("image_id", "place", F.col("prev").alias("left"), F.col("char").alias("right"), F.when(F.col("conf") <= F.col("pc"), F.col("place")).otherwise(F.col("place") - 1).alias("weaker"))


def _flip(char: str, conf: float) -> tuple[str, float]:
    return (FLIPS[char], conf * KEPT) if conf < THRESHOLD and char in FLIPS else (char, conf)


def corrected(chars: list[str], conf: list[float]) -> tuple[list[str], list[float]]:
    """First, doubled and last operators, then every operator after an operator, flipped where unsure."""
    chars, conf = list(chars), list(conf)
    if not chars:
        return chars, conf

    def flip(i: int) -> None:
        chars[i], conf[i] = _flip(chars[i], conf[i])

    if chars[0] in _OPERATORS:
        flip(0)
    for i in range(1, len(chars)):
        if chars[i] in _OPERATORS and chars[i - 1] in _OPERATORS:
            flip(i if conf[i] <= conf[i - 1] else i - 1)
    if chars[-1] in _OPERATORS:
        flip(-1)
    for i in range(1, len(chars)):
        if chars[i] in _OPERATORS and chars[i - 1] in _OPERATORS:
            flip(i)
    return chars, conf


def correct_sequences(seq: DataFrame) -> DataFrame:
    """(image_id, before, after) of whole sequences (image_id, place, char, conf)."""
    g = seq.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("place", "char", "conf"))).alias("s"))

    @F.pandas_udf("string")
    def after(chars: pd.Series, conf: pd.Series) -> pd.Series:
        return pd.Series(["".join(corrected(list(c), list(p))[0]) for c, p in zip(chars, conf)])

    return g.select("image_id", F.array_join("s.char", "").alias("before"), after("s.char", "s.conf").alias("after"))


def step(state: tuple[int, bool], char: str) -> tuple[int, bool] | None:
    """(open parentheses, whether a term must come) after one more character; None if it can't stand here.

    A parenthesis or digit after a term multiplies, so both may follow one."""
    depth, term = state
    if char.isdigit():
        return depth, False
    if char == "(":
        return depth + 1, True
    if char == ")":
        return (depth - 1, False) if depth and not term else None
    return (depth, True) if not term or char == "-" else None


# What a pair of neighbours adds to a reading's score, by the kinds of both.
BONUS = {("digit", "operator"): 0.05, (")", "operator"): 0.05, ("operator", "digit"): 0.04, ("(", "digit"): 0.04, ("(", "-"): 0.04, (")", "digit"): 0.03, (")", "("): 0.03, ("digit", "("): 0.03, ("digit", "digit"): 0.01}


def _kind(char: str) -> str:
    return "digit" if char.isdigit() else char if char in "()" else "operator"


def bonus(left: str, right: str) -> float:
    if not left:
        return 0.0
    if (left, right) == ("(", "-"):
        return BONUS["(", "-"]
    return BONUS.get((_kind(left), _kind(right)), 0.0)


def best_reading(options: list[list[tuple[str, float]]], width: int = 64) -> str:
    """The best-scored sequence of one option a place that is a whole expression, by beam search, the first of equals;
    each place's first option if there is none."""
    beam: dict[tuple, tuple[float, str]] = {(0, True, ""): (0.0, "")}
    for place in options:
        grown: dict[tuple, tuple[float, str]] = {}
        for (depth, term, last), (score, text) in beam.items():
            for char, conf in place:
                if (new := step((depth, term), char)) is None:
                    continue
                key, total = (*new, char), score + conf + bonus(last, char)
                if key not in grown or total > grown[key][0]:
                    grown[key] = (total, text + char)
        beam = dict(sorted(grown.items(), key=lambda kv: -kv[1][0])[:width])
    whole = [v for (depth, term, _), v in beam.items() if depth == 0 and not term]
    return max(whole, key=lambda v: v[0])[1] if whole else "".join(place[0][0] for place in options)


def read_lines(options: DataFrame) -> DataFrame:
    """(image_id, reading) from (image_id, place, char, conf) with several options a place."""
    by_place = options.groupBy("image_id", "place").agg(F.sort_array(F.collect_list(F.struct((-F.col("conf")).alias("minus"), "char"))).alias("o"))
    g = by_place.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("place", "o"))).alias("s"))

    @F.pandas_udf("string")
    def reading(lines: pd.Series) -> pd.Series:
        return pd.Series([best_reading([[(o["char"], -o["minus"]) for o in place["o"]] for place in line]) for line in lines], dtype=object)

    return g.select("image_id", reading("s").alias("reading"))
