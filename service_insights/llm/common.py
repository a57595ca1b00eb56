"""Reading, scratch space and shipping, shared by the operators."""
from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder ``spark.checkpoint.dir``.

    Only a local master may lack that setting; there a temporary folder is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def saved_at(df: DataFrame) -> tuple[DataFrame, str]:
    """Written to scratch space and read back, and the folder: cuts the lineage, and outlives any executor."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def saved(df: DataFrame) -> DataFrame:
    """``saved_at`` without the folder."""
    return saved_at(df)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_Held = TypeVar("_Held")
_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], _Held]) -> _Held:
    """A large object that a Python worker keeps between tasks: the last one used, of whichever operator.

    Workers outlive a stage and are used by the next one, so that what each stage leaves would add up.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


#: Bytes of an Arrow batch between Spark and a Python worker, unless the session has a setting of its own.
BATCH_BYTES = 4 << 20
_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application, and bounds their batches.

    The batch setting is changed only from Spark's default: 10,000 whole texts
    at a time would take memory outside the heap, twice for each task.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH_CONF, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")
    if getattr(sc, "_service_insights_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    folder = tempfile.mkdtemp(prefix="ship-")
    path = os.path.join(folder, "service_insights_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(os.path.join(top, "service_insights")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(d, name)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    sc._service_insights_shipped = True


def thinned(df: DataFrame, column: str, size: int) -> DataFrame:
    """About ``size`` rows at most, picked by a hash of a column: a filter, so no task sees more than its own rows."""
    n = df.count()
    if n <= size:
        return df
    return df.where(F.pmod(F.xxhash64(column), F.lit(1 << 40)) < int((1 << 40) * 0.95 * size / n))


def free_name(df: DataFrame, want: str) -> str:
    """``want`` with underscores in front until no column has that name (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want = "_" + want
    return want


def text_of(df: DataFrame, column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
