"""Summaries of assessment rows. Each is one group-by with map-side partial
aggregation, so the shuffle carries at most (components x classes) rows per
task regardless of input size or skew.

With ``weight`` the rows are counts already (``sources.run_counts``), of that
many rows each."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CLASSES, UNKNOWN
from .assess import is_catch


def _or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(UNKNOWN))


def _rows(weight: str | None, where: Column | None = None) -> Column:
    """How many rows (that fulfil a condition)."""
    if weight is None:
        return F.count(F.lit(1)) if where is None else F.count_if(where)
    return F.coalesce(F.sum(F.col(weight) if where is None else F.when(where, F.col(weight))), F.lit(0).cast("long"))


def distribution(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """Counts by (component, class); NULL or empty becomes '?' for both."""
    return (rows.select(_or_unknown(F.col("component_key")).alias("component_key"),
                        _or_unknown(F.col("classification")).alias("classification"), *([weight] if weight else []))
            .groupBy("component_key", "classification")
            .agg(_rows(weight).alias("n")))


def distribution_share(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """Share of each shown class within its component. The total counts
    every class (including '?'); only Urgent, Upcoming, Good are shown, in
    that order, and zero counts are absent."""
    dist = distribution(rows, weight)
    total = F.sum("n").over(Window.partitionBy("component_key"))
    order = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("classification"))
    return (dist.withColumn("total", total)
            .filter(F.col("classification").isin(*CLASSES))
            .select("component_key", "classification", "n", "total",
                    (F.col("n") / F.greatest(F.col("total"), F.lit(1))).alias("share"),
                    order.cast("int").alias("class_order")))


def distribution_pivot(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """One row per component with a count column per class (0 when absent),
    ``other`` for classes outside the enum (and '?'), and the total."""
    cls = _or_unknown(F.col("classification"))
    return (rows.select(_or_unknown(F.col("component_key")).alias("component_key"),
                        cls.alias("c"), *([weight] if weight else []))
            .groupBy("component_key")
            .agg(*[_rows(weight, F.col("c") == k).alias(k.lower()) for k in CLASSES],
                 _rows(weight, ~F.col("c").isin(*CLASSES)).alias("other"),
                 _rows(weight).alias("total")))


def catch_count(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """AI catches per component (not flagged, class Urgent or Upcoming)."""
    return (rows.groupBy("component_key")
            .agg(_rows(weight, is_catch(F.col("technician_flagged"), F.col("classification"))).alias("n_catches")))


def compare_summary(compared: DataFrame) -> DataFrame:
    """Total compared keys and how many differ."""
    return compared.agg(F.count(F.lit(1)).alias("total"),
                        F.count_if(F.col("differs")).alias("disagreements"))
