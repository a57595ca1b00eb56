"""Compare two configurations' assessments of the same services.

Semantics: keys are the union of both sides' (service_id, component_key),
NULL keys match each other; each side is first reduced to its latest row
per key; a missing row counts as a NULL class; ``differs`` is NULL-safe
inequality of the classes; notes come from A when A has the service's key,
else B.

Plan: each side is shuffled once, by the whole key, after a limit of one row per
key and map task; the join finds both sides where the windows left them. The key
is one struct, equal where its fields are, NULLs included, so it is a plain join
key. After the windows a key has one row a side: a hot service (0 stands for
every NULL id in stored runs) is spread over the tasks by its components, and has
no copies left for the join to pile up. Notes are not carried with every
component: they are reduced to one row per service and side, and joined to the
result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assess import latest

_KEYS = ["service_id", "component_key"]


def _winners(rows: DataFrame, seq_col: str | None, side: str) -> DataFrame:
    seq = F.col(seq_col) if seq_col else F.lit(0)
    keyed = rows.select(F.struct(*_KEYS).alias("_key"), "classification", "reasoning", seq.alias("_run"), F.col("pos").alias("_pos"))
    return latest(keyed, ["_key"], ["_run", "_pos", "classification", "reasoning"]) \
        .select("_key", F.lit(True).alias(f"in_{side}"), F.col("classification").alias(f"{side}_classification"),
                F.col("reasoning").alias(f"{side}_reasoning"))


def compare_keyed(a_rows: DataFrame, b_rows: DataFrame, seq_col: str | None = None) -> DataFrame:
    """The comparison without notes. Both frames need service_id,
    component_key, classification, reasoning and pos (place in the answer)."""
    both = _winners(a_rows, seq_col, "a").join(_winners(b_rows, seq_col, "b"), "_key", "full_outer")
    return both.select(
        *[F.col(f"_key.{k}").alias(k) for k in _KEYS],
        F.col("in_a").isNotNull().alias("in_a"), "a_classification", "a_reasoning", "b_classification", "b_reasoning",
        (~F.col("a_classification").eqNullSafe(F.col("b_classification"))).alias("differs"))


def with_notes(compared: DataFrame, a_notes: DataFrame, b_notes: DataFrame | None = None) -> DataFrame:
    """Add ``service_performed`` from tables with one row per service: A's for
    keys that A has, else B's (one table may serve both)."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("service_id").alias(f"_sid{name}"), F.col("service_performed").alias(f"_n{name}"))

    out = compared.join(side(a_notes, "a"), F.col("service_id").eqNullSafe(F.col("_sida")), "left")
    notes = F.col("_na")
    if b_notes is not None:
        out = out.join(side(b_notes, "b"), F.col("service_id").eqNullSafe(F.col("_sidb")), "left")
        notes = F.when(F.col("in_a"), notes).otherwise(F.col("_nb"))
    return out.select("service_id", "component_key", notes.alias("service_performed"), "a_classification",
                      "a_reasoning", "b_classification", "b_reasoning", "differs")


def compare_rows(a_rows: DataFrame, b_rows: DataFrame, seq_col: str | None = None) -> DataFrame:
    """Row-level comparison of two assessment frames that carry their notes
    (``service_performed``, the same in all rows of a service)."""
    notes = [r.select("service_id", "service_performed").distinct() for r in (a_rows, b_rows)]
    return with_notes(compare_keyed(a_rows, b_rows, seq_col), *notes)


def diffs_only(compared: DataFrame) -> DataFrame:
    """Only the keys where the two configurations disagree."""
    return compared.filter(F.col("differs"))
