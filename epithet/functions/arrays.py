"""Array helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def unnest(c: Column | str) -> Column:
    """``explode`` of an expression instead of a column.

    Exploding a plain column makes Catalyst infer ``size(c) > 0`` and push it below the
    projections that built ``c``; the inlined copy of nested ``transform`` calls is then
    evaluated again for every element.  An expression is left alone.
    """
    return F.explode(F.transform(c, lambda x: x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once: a lambda over an array of one element."""
    return F.get(F.transform(F.array(value), body), 0)
