"""A local session for tests and benches, and the limit that holds in any session."""
from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings the library relies on; on a cluster they come from the job config.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# The fixture derivation and the rule scorer are wide projections; fused
# into the aggregate's output method they pass the JVM's 8000-byte JIT
# limit and would run interpreted. Cluster jobs set the same flag in
# spark.driver/executor.extraJavaOptions.
JAVA_OPTIONS = "-XX:-DontCompileHugeMethods"

# The largest method that HotSpot compiles without that flag, in bytes.
_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_METHOD_BYTES = 8000


def small_methods(spark: SparkSession) -> None:
    """Spark's own limit for generated methods, lowered to HotSpot's.

    The fixture projection and the scorer fuse into one method of 18 KB, which
    runs interpreted. Above this limit Spark runs the same projections one by
    one, each split into methods that are compiled. A session with a lower
    limit keeps it; the results never depend on it."""
    if int(spark.conf.get(_METHOD_LIMIT, "65535")) > _METHOD_BYTES:
        spark.conf.set(_METHOD_LIMIT, str(_METHOD_BYTES))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "service_insights") -> SparkSession:
    """A local session for tests and benches (never used on a cluster)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("SI_DRIVER_MEMORY", "8g"))
               .config("spark.driver.extraJavaOptions", JAVA_OPTIONS)
               .config("spark.executor.extraJavaOptions", JAVA_OPTIONS))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
