"""Picking from a fixed list of values by a computed position."""
from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick(values, pos: Column) -> Column:
    """The ``pos``-th (1-based) of ``values``; NULL when ``pos`` is NULL or
    out of range. Uses ``get`` rather than ``element_at``: on a literal
    array, ``element_at`` with a NULL position gives the last element
    (seen on Spark 4.1.2), where NULL is meant."""
    return F.get(F.array(*[F.lit(v) for v in values]), (pos - F.lit(1)).cast("int"))


def jvm_cached(fn):
    """Memoise a pure builder of Columns, per JVM gateway.

    A Column is an unresolved expression that any DataFrame may reuse, and
    building one costs a py4j round trip per node: the rule scorer and the
    fixture derivation are thousands of nodes, seconds per query when
    rebuilt. Arguments must be hashable."""
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        from pyspark import SparkContext
        key = (id(SparkContext._gateway), args)
        if key not in cache:
            cache[key] = fn(*args)
        return cache[key]
    return wrapper


def zero_padded(c: Column, width: int) -> Column:
    """A number as text with leading zeros up to ``width``; longer numbers
    stay whole (``lpad`` alone would cut them)."""
    t = c.cast("string")
    return F.when(F.length(t) < width, F.lpad(t, width, "0")).otherwise(t)
