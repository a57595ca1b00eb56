"""Keyed operations on the answers held by ONE row (no shuffle).

When every answer about a service sits on that service's row -- several
runs scored in the same pass, or a model that repeats a component inside
one answer -- "latest per (service, component)" and "compare A with B per
(service, component)" are row-local. They are done here with array
functions, O(n log n) in the answer length: entries are sorted by
(key, run, position) and each one looks only at its neighbours. Nothing
is shuffled, so a hot service is just a longer row.

Frames whose answers come from different sources (stored runs) go
through ``assess.dedupe_latest`` / ``compare.compare_keyed``, which group
by the key.

Each sorted array is its own column in its own projection: a lambda that
referenced the sort expression would re-sort per element.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows

ENTRY = "struct<component:string,classification:string,reasoning:string>"


def _empty() -> Column:
    return F.array().cast(f"array<{ENTRY}>")


def tagged(answers: Column, run: int) -> Column:
    """Entries of one answer (``result.assessments``) with a sort key:
    NULL component last, the component, the run, the position."""
    arr = F.coalesce(answers, _empty())
    return F.transform(arr, lambda x, i: F.struct(
        x["component"].isNull().alias("kn"), F.coalesce(x["component"], F.lit("")).alias("k"),
        F.lit(run).alias("run"), i.alias("pos"), x.alias("e")))


def _same_key(x: Column, y: Column) -> Column:
    return F.coalesce((x["kn"] == y["kn"]) & (x["k"] == y["k"]), F.lit(False))


def latest_per_key(df: DataFrame, entries_col: str, out_col: str) -> DataFrame:
    """Keep, per component key, the entry of the latest (run, position) in
    ``entries_col`` (an array of :func:`tagged` entries); sorted by key."""
    srt = f"{out_col}__sorted"
    df = df.withColumn(srt, F.sort_array(F.col(entries_col)))
    s = F.col(srt)
    last = F.filter(s, lambda x, i: ~_same_key(x, F.get(s, i + 1)))
    return df.withColumn(out_col, last).drop(srt)


def dedupe_runs(df: DataFrame, answer_cols: list[str], keep: list[str]) -> DataFrame:
    """One row per (row, component): the latest of the answers in
    ``answer_cols`` (later columns are later runs; inside an answer the
    later position wins)."""
    runs = F.concat(*[tagged(F.col(c), i) for i, c in enumerate(answer_cols)])
    d = latest_per_key(df.select(*keep, runs.alias("_runs")), "_runs", "_latest")
    return (explode_rows(d, keep, F.col("_latest"), val="x")
            .select(*keep, F.col("x.e.component").alias("component_key"),
                    F.col("x.e.classification").alias("classification"),
                    F.col("x.e.reasoning").alias("reasoning")))


def compare_answers(df: DataFrame, a_col: str, b_col: str, keep: list[str]) -> DataFrame:
    """Compare two answers on each row per component key: keys are the
    union of both; each side is reduced to its latest entry per key; a
    missing side is a NULL class; ``differs`` is NULL-safe inequality."""
    d = df.select(*keep, tagged(F.col(a_col), 0).alias("_a"), tagged(F.col(b_col), 1).alias("_b"))
    d = latest_per_key(d, "_a", "_la")
    d = latest_per_key(d, "_b", "_lb")
    # Each key now has at most one A and one B entry; sorted, A comes first.
    d = d.withColumn("_ab", F.sort_array(F.concat("_la", "_lb")))
    ab = F.col("_ab")
    pairs = F.transform(ab, lambda x, i: F.struct(
        x.alias("x"),
        F.when(_same_key(x, F.get(ab, i + 1)), F.get(ab, i + 1)).alias("nxt"),
        _same_key(F.get(ab, i - 1), x).alias("has_prev")))
    keep_pair = F.filter(pairs, lambda p: (p["x"]["run"] == 0) | ~p["has_prev"])
    rows = explode_rows(d, keep, keep_pair, val="p")
    is_a = F.col("p.x.run") == 0
    a = F.when(is_a, F.col("p.x.e"))
    b = F.when(is_a, F.col("p.nxt.e")).otherwise(F.col("p.x.e"))
    a_cls, b_cls = a["classification"], b["classification"]
    return rows.select(
        *keep, F.col("p.x.e.component").alias("component_key"),
        a_cls.alias("a_classification"), a["reasoning"].alias("a_reasoning"),
        b_cls.alias("b_classification"), b["reasoning"].alias("b_reasoning"),
        (~a_cls.eqNullSafe(b_cls)).alias("differs"))
