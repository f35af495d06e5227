from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)
