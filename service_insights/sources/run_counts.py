"""Summaries of stored runs that a new run is added to without reading the old ones.

``add`` keeps the counts of one run by (component, class, flagged): a few rows,
whatever the run's size. The summaries of ``operators.summarize`` take them with
``weight='n'`` and give what they give on the runs' rows. Adding a run again
replaces its counts.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.summarize import compare_summary

SCHEMA = "component_key string, classification string, technician_flagged boolean, n long, run_id string"
COMPARED = "total long, disagreements long, pair string"


def counts(rows: DataFrame) -> DataFrame:
    """(component_key, classification, technician_flagged, n), NULLs as they are: one aggregation, combined map-side."""
    return rows.groupBy("component_key", "classification", "technician_flagged").agg(F.count(F.lit(1)).alias("n"))


def _put(df: DataFrame, path: str, key: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def add(rows: DataFrame, run_id: str, path: str) -> None:
    """Keeps the counts of a run; a run without rows keeps one of zero, so that it replaces an earlier one too."""
    zero = rows.sparkSession.createDataFrame([(None, None, None, 0)], "component_key string, classification string, technician_flagged boolean, n long")
    _put(counts(rows).unionByName(zero).withColumn("run_id", F.lit(run_id)), path, "run_id")


def read(spark: SparkSession, path: str, runs: list[str] | None = None) -> DataFrame:
    """The counts of all runs, or of some (partition pruning)."""
    out = spark.read.schema(SCHEMA).parquet(path).where("n > 0")
    return out if runs is None else out.where(F.col("run_id").isin(*runs))


def add_comparison(compared: DataFrame, run_a: str, run_b: str, path: str) -> None:
    """Keeps the totals of one comparison."""
    _put(compare_summary(compared).withColumn("pair", F.lit(f"{run_a}~{run_b}")), path, "pair")


def compare_totals(spark: SparkSession, path: str) -> DataFrame:
    """Totals over all comparisons kept."""
    return spark.read.schema(COMPARED).parquet(path).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("disagreements"), F.lit(0)).alias("disagreements"))
