"""Evaluate a sub-expression once and use it many times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A column used inside a lambda, such as a vector's length while its elements are being
    divided, is otherwise evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), lambda bound: body(bound)), 1)
