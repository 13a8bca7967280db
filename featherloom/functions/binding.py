"""A value that is computed once and named several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(c: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of the value of c, which is computed once. A column that a lambda function names is computed again in each of its calls."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))
