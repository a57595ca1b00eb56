"""Array-to-rows helpers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list, arr: Column, val: str = "a",
                 pos: str | None = None) -> DataFrame:
    """Rows of ``explode(arr)`` (empty and NULL arrays give none; NULL
    elements are kept), as ``keep`` + [``pos``] + ``val``.

    Written as ``posexplode_outer`` + ``pos IS NOT NULL``: for a plain
    ``explode`` the optimizer infers ``size(arr) > 0`` and pushes it below
    the projections that build ``arr``, inlining the whole scorer into a
    Filter that runs it a second time per row."""
    p = pos or "_pos"
    out = df.select(*keep, F.posexplode_outer(arr).alias(p, val)).filter(F.col(p).isNotNull())
    return out if pos else out.drop(p)
