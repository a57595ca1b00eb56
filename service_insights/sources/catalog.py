"""App catalogs as tables: components, saved configs, runs and run results.

These are small metadata tables; the generic keyed operators of
``registry`` maintain them, so the same code serves a 12-row catalog and a
customer-size dimension.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..constants import SEED_COMPONENTS
from . import registry


def seed_components(spark: SparkSession) -> DataFrame:
    """The 12 seed components (all enabled)."""
    rows = [(k, n, d, r, True, o) for k, n, d, r, o in SEED_COMPONENTS]
    return spark.createDataFrame(rows, schemas.COMPONENTS)


def seed_into(components: DataFrame, spark: SparkSession) -> DataFrame:
    """Insert-only merge of the seed: existing keys keep their edits."""
    return registry.merge_insert_only(components, seed_components(spark), ["component_key"])


def upsert_components(components: DataFrame, updates: DataFrame) -> DataFrame:
    """Replace matched components, insert new ones; repeated keys raise."""
    return registry.merge_upsert(components, updates, ["component_key"])


def delete_components(components: DataFrame, keys: list[str], spark: SparkSession) -> DataFrame:
    doomed = spark.createDataFrame([(k,) for k in keys], "component_key string")
    return registry.delete_by_keys(components, doomed, ["component_key"])


def lookup_config(spark: SparkSession, configs_view: str, config_id: str) -> dict:
    """One saved config by id; missing is an error. The id is a literal of the
    plan, never part of a statement's text."""
    rows = (spark.table(configs_view).filter(F.col("config_id") == F.lit(config_id))
            .select("config_id", "name", "model_endpoint", "prompt_text", "components").take(1))
    if not rows:
        raise KeyError(f"config {config_id} not found")
    r = rows[0].asDict()
    try:
        r["components"] = json.loads(r.get("components") or "[]")
    except (json.JSONDecodeError, TypeError):
        r["components"] = []
    return r


def new_config_row(spark: SparkSession, name: str, model_endpoint: str, components: list[dict],
                   prompt_text: str = "", description: str = "",
                   response_format: str = "") -> tuple[str, DataFrame]:
    """A new immutable config row: fresh id, current user, both timestamps
    now. Returns (config_id, one-row frame to append)."""
    config_id = uuid.uuid4().hex
    now = F.current_timestamp()
    row = spark.range(1).select(
        F.lit(config_id).alias("config_id"), F.lit(name).alias("name"),
        F.lit(description).alias("description"), F.lit(model_endpoint).alias("model_endpoint"),
        F.lit(json.dumps(components)).alias("components"), F.lit(prompt_text).alias("prompt_text"),
        F.lit(response_format).alias("response_format"), F.current_user().alias("created_by"),
        now.alias("created_at"), now.alias("updated_at"))
    return config_id, row


def run_rows(spark: SparkSession, rows: DataFrame, run_id: str, config_id: str | None,
             config_name: str, model_endpoint: str, source_table: str,
             limit: int | None) -> tuple[DataFrame, DataFrame]:
    """(run row, result rows) to append. ``row_count`` stores the requested
    limit (0 for a whole table), not the rows produced; NULL service ids become 0 and a missing
    config id ''. Results keep only the five stored columns."""
    run = spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(config_id or "").alias("config_id"),
        F.lit(config_name).alias("config_name"), F.lit(model_endpoint).alias("model_endpoint"),
        F.lit(source_table).alias("source_table"), F.lit(int(limit or 0)).cast("int").alias("row_count"),
        F.current_timestamp().alias("created_at"))
    return run, result_rows(rows, run_id)


def result_rows(rows: DataFrame, run_id: str) -> DataFrame:
    """The five stored columns of a run's rows."""
    return rows.select(F.lit(run_id).alias("run_id"),
                       F.coalesce(F.col("service_id"), F.lit(0)).cast("long").alias("service_id"),
                       "component_key", "classification", "reasoning")


def append_config(configs_path: str, row: DataFrame) -> None:
    """S8: append one new config row to the stored configs."""
    registry.append(row, configs_path)
