"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
    return r["n"], r["s"]


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Each node's neighbours are joined to the smallest of them and itself."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges.join(low, "u")
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, u: str = "a", v: str = "b") -> DataFrame:
    """(node, label): label is the smallest node that links reach; only nodes with links are listed.

    A round makes no more edges than it takes, and no group is gathered: a hub's
    rows meet it in a join, which Spark can split. Empty edges give no rows.
    """
    now = edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).distinct()
    now = saved(now)
    seen = _signature(now)
    while seen[0]:
        after = saved(_stars(_stars(now, True), False))
        sign = _signature(after)
        now = after
        if sign == seen:
            break
        seen = sign
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).groupBy("node").agg(F.min("label").alias("label"))
