import pytest
from pyspark.sql import functions as F

from inkframe.operators import expressions as X

# tokens, expression, result, error (None: no error; a prefix ends in *)
CASES = [
    ("3--2", "3-2", "1", None), ("6/2", "6/2", "3", None), ("7/3", "7/3", "2.3333333333333335", None), ("2(3)", "2*(3)", "6", None), ("(2)(3)", "(2)*(3)", "6", None),
    ("(2)3", "(2)*3", "6", None), (")5", "95", "95", None), ("5(", "59", "59", None), ("0906", "0906", "0906", None), ("05+3", "05+3", None, "Evaluation error:*"),
    ("(+3)", "(+3)", "3", None), ("(-2)", "(-2)", "-2", None), ("3*-2", "3*-2", None, "Validation failed: Two consecutive operators '*' and '-' at position 2."),
    ("+3", "+3", None, "Validation failed: Expression cannot start with '+'."), ("3+", "3+", None, "Validation failed: Expression cannot end with '+'."),
    ("5/0", "5/0", None, "Division by zero is not allowed."), ("((2", "((2", None, "Validation failed: Unmatched '(' - parentheses are not balanced."),
    ("2)+1", "2)+1", None, "Validation failed: Unmatched ')' at position 1."), ("()+1", "()+1", None, "Validation failed: Empty parentheses '()' found."),
    ("))5", "9)*5", None, "Validation failed: Unmatched ')' at position 1."), ("", "", None, "Validation failed: Expression is empty."),
    ("(*3)", "(*3)", None, "Evaluation error:*"), ("(3-)", "(3-)", None, "Evaluation error:*"), ("00+3", "00+3", "3", None), ("2*3+4", "2*3+4", "10", None), ("8-3-2", "8-3-2", "3", None),
    ("(1*7)*3+5/6", "(1*7)*3+5/6", "21.833333333333332", None), ("9" * 20 + "*9", "9" * 20 + "*9", str(int("9" * 20) * 9), None),
]


@pytest.fixture(scope="module")
def evaluated(spark):
    df = spark.createDataFrame([(i, list(c[0])) for i, c in enumerate(CASES)], "i int, tokens array<string>")
    return {r.i: r for r in X.evaluate(df).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[c[0] or "empty" for c in CASES])
def test_case(evaluated, i):
    _, expression, result, error = CASES[i]
    r = evaluated[i]
    assert (r.expression, r.result) == (expression, result)
    assert r.error.startswith(error[:-1]) if error and error.endswith("*") else r.error == error


def test_clean_keeps_parentheses_and_drops_blanks(spark):
    df = spark.createDataFrame([([" 1 ", "", "+", "+", "(", "(", "÷", "÷", "2"],)], "t array<string>")
    assert df.select(X.clean(F.col("t")).alias("c")).first().c == ["1", "+", "(", "(", "÷", "2"]
