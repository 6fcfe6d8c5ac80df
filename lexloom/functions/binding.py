"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Common subexpressions are not eliminated inside higher-order functions: an array that is built in place and used for each of its
    own elements would be built as often as it is long."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
