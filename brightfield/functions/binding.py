"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    A lambda's variable is never replaced by its definition, so the plan does not grow with every mention as a nested expression does.
    """
    return F.transform(F.array(value), body)[0]
