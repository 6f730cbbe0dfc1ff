"""Token sequences to expressions to results.

Cleaning, correction, implicit multiplication and validation are column expressions; only the
arithmetic itself, with unbounded integers, runs in a pandas UDF on rows that passed validation.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import OPERATORS

_OPS = "+\\-*/÷"


def clean(tokens: Column) -> Column:
    """Trimmed tokens without blanks; a run of one operator becomes one."""
    kept = F.filter(F.transform(tokens, lambda t: F.trim(t)), lambda t: t != "")
    return F.aggregate(kept, F.expr("cast(array() as array<string>)"), lambda acc, t: F.when(t.isin(*OPERATORS) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) == t), acc).otherwise(F.concat(acc, F.array(t))))


def auto_correct(tokens: Column) -> Column:
    """A leading ) and a trailing ( that nothing asks for are misread nines."""
    n = F.size(tokens)
    head = F.when((n > 0) & (F.try_element_at(tokens, F.lit(1)) == ")"), F.concat(F.array(F.lit("9")), F.slice(tokens, 2, F.greatest(n, F.lit(1))))).otherwise(tokens)
    before = F.slice(head, 1, F.greatest(n - 1, F.lit(0)))
    count = lambda c: F.size(F.filter(before, lambda t: t == c))
    misread = (n > 0) & (F.try_element_at(head, F.lit(-1)) == "(") & (count("(") <= count(")"))
    return F.when(misread, F.concat(before, F.array(F.lit("9")))).otherwise(head)


def multiply(expression: Column) -> Column:
    """A * where a digit or ) meets (, and where ) meets a digit."""
    return F.regexp_replace(expression, r"(?<=[0-9)])(?=\()|(?<=\))(?=[0-9])", "*")


def first_unmatched(expression: Column) -> Column:
    """0-based place of the first ) without a (, or -1."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))
    step = lambda a, c: F.struct(
        (a["depth"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("depth"), (a["at"] + 1).alias("at"),
        F.when((a["bad"] < 0) & (c == ")") & (a["depth"] == 0), a["at"]).otherwise(a["bad"]).alias("bad"))
    return F.aggregate(F.split(expression, ""), start, step, lambda a: a["bad"])


def depth(expression: Column) -> Column:
    return F.regexp_count(expression, F.lit(r"\(")) - F.regexp_count(expression, F.lit(r"\)"))


def validation_error(e: Column) -> Column:
    """The first rule that a normalised expression breaks, as text; null if none."""
    pair = F.regexp_instr(e, F.lit(f"[{_OPS}][{_OPS}]"))
    bad = first_unmatched(e)
    return (
        F.when(e == "", "Expression is empty.")
        .when(e.rlike("^[+*/÷)]"), F.concat(F.lit("Expression cannot start with '"), F.substring(e, 1, 1), F.lit("'.")))
        .when(e.rlike(f"[{_OPS}(]$"), F.concat(F.lit("Expression cannot end with '"), F.right(e, F.lit(1)), F.lit("'.")))
        .when(pair > 0, F.concat(F.lit("Two consecutive operators '"), F.substr(e, pair, F.lit(1)), F.lit("' and '"), F.substr(e, pair + 1, F.lit(1)), F.lit("' at position "), pair.cast("string"), F.lit(".")))
        .when(bad >= 0, F.concat(F.lit("Unmatched ')' at position "), bad.cast("string"), F.lit(".")))
        .when(depth(e) != 0, "Unmatched '(' - parentheses are not balanced.")
        .when(F.contains(e, F.lit("()")), "Empty parentheses '()' found.")
    )


_LEXEME = re.compile(r"\d+|[-+*/()]")


def arithmetic(text: str) -> str:
    """The value as text: integers without bound, division as a double; errors as in a programming language."""
    tokens = _LEXEME.findall(text.replace("÷", "/"))
    if "".join(tokens) != text.replace("÷", "/"):
        raise SyntaxError("unknown symbol")
    values: list = []
    waiting: list[str] = []
    rank = {"+": 1, "-": 1, "*": 2, "/": 2, "u+": 3, "u-": 3}

    def apply() -> None:
        op = waiting.pop()
        if op[0] == "u":
            if not values:
                raise SyntaxError("an operand is missing")
            values.append(-values.pop() if op == "u-" else values.pop())
            return
        if len(values) < 2:
            raise SyntaxError("an operand is missing")
        b, a = values.pop(), values.pop()
        if op == "/" and b == 0:
            raise ZeroDivisionError
        values.append(a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else a / b)

    term = True  # whether a term must come next
    for t in tokens:
        if t.isdigit():
            if not term or len(t) > 1 and t[0] == "0" and t.strip("0"):
                raise SyntaxError("a number stands where it can't")
            values.append(int(t))
            term = False
        elif t == "(":
            if not term:
                raise SyntaxError("a parenthesis stands where it can't")
            waiting.append(t)
        elif t == ")":
            if term:
                raise SyntaxError("an operand is missing")
            while waiting and waiting[-1] != "(":
                apply()
            if not waiting:
                raise SyntaxError("unbalanced")
            waiting.pop()
        elif term:
            if t not in "+-":
                raise SyntaxError("an operand is missing")
            waiting.append("u" + t)
        else:
            while waiting and waiting[-1] != "(" and rank[waiting[-1]] >= rank[t]:
                apply()
            waiting.append(t)
            term = True
    if term:
        raise SyntaxError("an operand is missing")
    while waiting:
        apply()
    value = values.pop()
    return str(int(value)) if isinstance(value, float) and value.is_integer() else repr(value)


@F.pandas_udf(T.StructType([T.StructField("result", T.StringType()), T.StructField("error", T.StringType())]))
def _evaluated(expression: pd.Series) -> pd.DataFrame:
    known: dict[str, tuple] = {}
    for e in expression.dropna().unique():
        try:
            known[e] = (arithmetic(e), None)
        except ZeroDivisionError:
            known[e] = (None, "Division by zero is not allowed.")
        except Exception as bad:  # noqa: BLE001  any other failure is a row's result, not the job's
            known[e] = (None, f"Evaluation error: {bad}")
    return pd.DataFrame([known.get(e, (None, None)) for e in expression], columns=["result", "error"])


def evaluate(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``df`` with expression, result and error."""
    e = multiply(F.array_join(auto_correct(clean(F.col(tokens))), ""))
    checked = df.withColumn("expression", e).withColumn("invalid", F.when(~F.col("expression").rlike("^[0-9]+$"), validation_error(F.col("expression"))))
    digits = F.col("expression").rlike("^[0-9]+$")
    open_ = F.when(~digits & F.col("invalid").isNull(), F.col("expression"))
    done = checked.withColumn("value", _evaluated(open_))
    return done.withColumns({
        "result": F.when(digits, F.col("expression")).otherwise(F.col("value.result")),
        "error": F.coalesce(F.concat(F.lit("Validation failed: "), F.col("invalid")), F.col("value.error")),
    }).drop("invalid", "value")


def line_summary(lines: DataFrame) -> DataFrame:
    """Per image: one line's own values, else how many lines were read and how many evaluate."""
    n, ok = F.count("*"), F.count_if(F.col("error").isNull())
    one = lambda c: F.first(c)
    return lines.groupBy("image_id").agg(
        F.when(n == 1, one("expression")).otherwise(F.concat(F.lit("Detected "), n.cast("string"), F.lit(" lines"))).alias("expression"),
        F.when(n == 1, one("result")).otherwise(F.concat(ok.cast("string"), F.lit("/"), n.cast("string"), F.lit(" lines evaluated successfully"))).alias("result"),
        n.alias("n_lines"),
    )
