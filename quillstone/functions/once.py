"""Values that are worked out once, however often an expression names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value bound to a lambda's variable: an expression that names a column's expression n times evaluates it n times."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
