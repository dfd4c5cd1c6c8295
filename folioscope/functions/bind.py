"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` computed once per row, however often f uses it, also inside its lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))
