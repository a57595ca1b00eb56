"""Readers for the supplied parquet tables and for written tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SUPPLIED_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                   "events", "documents", "embeddings", "pages", "benchmark", "labels",
                   "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one supplied table; Catalyst prunes columns and pushes filters
    into this scan, so callers select only what they need."""
    return spark.read.parquet(table_path(sf_dir, name))
