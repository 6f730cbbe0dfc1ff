"""The class vocabulary and label clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 16 classes in index order, operators, what labels are called (by the server, by its page and
# by the folders of training pictures), and their names in file names.
VOCABULARY = list("0123456789+-*/()")
OPERATORS = ["+", "-", "*", "/", "÷"]
ALIASES = {"plus": "+", "minus": "-", "mul": "*", "times": "*", "x": "*", "X": "*", "div": "/", "slash": "/", "forward_slash": "/", "÷": "/", "lparen": "(", "rparen": ")"}
PAGE_ALIASES = {"x": "*", "X": "*", "×": "*", "÷": "/", ":": "/"}
FOLDER_ALIASES = {"plus": "+", "minus": "-", "mul": "*", "times": "*", "div": "/", "slash": "/", "forward_slash": "/", "lparen": "(", "rparen": ")"}
TOKENS = {"+": "plus", "-": "minus", "*": "mul", "/": "div", "(": "lparen", ")": "rparen"}


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def normal_label(label: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """Trimmed, aliases replaced; blank stays blank."""
    t = F.regexp_replace(F.coalesce(label, F.lit("")), r"^\s+|\s+$", "")
    return F.coalesce(F.try_element_at(literal_map(aliases), t), t)


def folder_label(name: Column) -> Column:
    """The label that a folder of training pictures names; null if blank."""
    return F.nullif(normal_label(name, FOLDER_ALIASES), F.lit(""))


def label_token(label: Column) -> Column:
    """A label as part of a file name."""
    t = normal_label(label)
    return F.coalesce(F.try_element_at(literal_map(TOKENS), t), F.when(t.rlike(r"^[\p{L}\p{N}]+$"), t), F.lit("unknown"))


def char_type(char: Column) -> Column:
    """digit, operator or unknown; parentheses are unknown."""
    return F.when(char.rlike("^[0-9]$"), "digit").when(char.isin(*OPERATORS, "×", "="), "operator").otherwise("unknown")


def expected_type(before: Column) -> Column:
    """What should follow a character: a digit at the start and after an operator, else anything."""
    return F.when(before.isNull() | (char_type(before) == "operator"), "expected_digit").otherwise("expected_any")


def escaped(text: Column) -> Column:
    """Text for a page: the five characters that html gives a meaning."""
    out = F.coalesce(text, F.lit(""))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out
