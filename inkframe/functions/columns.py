"""Columns made of values that the plan holds once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(values: Sequence[Column], body: Callable[..., Column]) -> Column:
    """``body`` of values that are found once each, however often the body names them: a column that is named again
    inside a list function is found again for every element."""
    packed = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.element_at(F.transform(F.array(packed), lambda p: body(*[p[f"v{i}"] for i in range(len(values))])), 1)
