"""Binding a value inside a Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    An expression named several times, or inside a lambda, may otherwise be evaluated
    at every mention.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
