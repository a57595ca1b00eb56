"""Keyed tables stored in buckets of their key, of which a change rewrites only those that its batch touches.

A table is a Parquet folder partitioned by ``key_bucket``, a hash of the key modulo
the number of buckets. The merges are the operators of ``registry``, run over the
touched buckets alone (partition pruning) and written back by dynamic partition
overwrite: Spark writes aside first and then replaces just the partitions of the
result. A bucket that a delete leaves without rows is overwritten with none. Lost
executors cost a retry; a driver that dies while Spark moves finished buckets in may
leave some of them old and some new, so a table that must change as one is published
whole (``registry.publish``).
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import registry, scratch

BUCKET = "key_bucket"


class KeyedTable:
    """``keys`` may be NULL; such rows share a bucket, and match nothing in a merge."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _placed(self, df: DataFrame) -> DataFrame:
        # as text: a batch's key of another whole-number type falls into the same bucket
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int"))

    def _write(self, placed: DataFrame) -> None:
        # one task a bucket and so few files; a bucket is a bounded share of the table
        (placed.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(BUCKET).parquet(self.path))

    def create(self, df: DataFrame) -> None:
        self._placed(df).repartition(BUCKET).write.partitionBy(BUCKET).parquet(self.path)

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def touched(self, batch: DataFrame) -> list[int]:
        """Buckets of the batch's keys: no more numbers than there are buckets."""
        return sorted(r[0] for r in self._placed(batch.select(*self.keys)).select(BUCKET).distinct().collect())

    def _merge(self, batch: DataFrame, operator: Callable[[DataFrame, DataFrame, list[str]], DataFrame]) -> list[int]:
        batch = scratch.kept(batch, "batch")  # read twice; and it may read this table
        touched = self.touched(batch)
        if touched:
            self._write(self._placed(operator(self._stored().where(F.col(BUCKET).isin(touched)).drop(BUCKET), batch, self.keys)))
        return touched

    def upsert(self, batch: DataFrame) -> list[int]:
        """S11. Returns the buckets rewritten."""
        return self._merge(batch, registry.merge_upsert)

    def insert_new(self, batch: DataFrame) -> list[int]:
        """S10. Returns the buckets rewritten."""
        return self._merge(batch, registry.merge_insert_only)

    def delete(self, doomed: DataFrame) -> list[int]:
        """S12. Returns the buckets rewritten."""
        doomed = scratch.kept(doomed.select(*self.keys), "doomed")
        touched = self.touched(doomed)
        if not touched:
            return []
        left = registry.delete_by_keys(self._stored().where(F.col(BUCKET).isin(touched)).drop(BUCKET), doomed, self.keys)
        left = scratch.kept(self._placed(left), "left")  # to know which buckets keep rows
        full = {r[0] for r in left.select(BUCKET).distinct().collect()}
        self._write(left)
        for bucket in set(touched) - full:
            left.where("false").drop(BUCKET).write.mode("overwrite").parquet(f"{self.path}/{BUCKET}={bucket}")
        return touched


def store_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """A catalog table bucketed and sorted by ``key``: joins and group-bys on the key need no exchange.

    Rows are dealt by the bucket's own hash first, so that a bucket is one file."""
    spark = df.sparkSession
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)
