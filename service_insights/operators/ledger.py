"""A store of paid model answers, so that a broken or repeated run sends no request twice.

Every answer is a row keyed by a request: a digest of the service's key, of all
that the scorer sends beside the text (model, prompt, options, schema), and of the
text. A run looks its requests up by an anti-join, calls the model for those
without an answer (new ones, and those whose call failed), and appends what came
back. The table only grows; a request has any number of failures and at most one
answer.

The work is cut into slices by the request's hash, each one job whose rows are
committed when it ends. A run that is killed loses the answers of the slice that
was open, not those before. One run at a time may use a ledger: two at once would
both send what neither has found.
"""
from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..sources import scratch
from .assess import latest
from .scoring import score_python

SCHEMA = "request string, service_id long, raw string, error string, run string, answered_at timestamp"
#: Jobs that a run's calls are cut into.
SLICES = 8


def request(scorer, key: Column, text: Column) -> Column:
    """The request's digest; NULL where there is no text (nothing is sent).

    ``scorer.body`` with an empty text stands for all that is the same in every request."""
    fixed = hashlib.sha256(json.dumps(scorer.body(""), sort_keys=True).encode()).hexdigest()
    of = F.concat_ws(":", F.lit(fixed), F.coalesce(key.cast("string"), F.lit("-")), text)
    return F.when(text.isNotNull(), F.sha2(of.cast("binary"), 256))


class Ledger:
    """The table below ``path``; missing is empty."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def outcomes(self) -> DataFrame:
        """(request, raw, error): the answer of each request, or why its last call gave none."""
        rows = self.rows().withColumn("_ok", F.col("raw").isNotNull())
        return latest(rows, ["request"], ["_ok", "answered_at", "run"]).select("request", "raw", "error")

    def todo(self, requests: DataFrame) -> DataFrame:
        """Distinct requests (request, service_id, text) that have no answer yet."""
        asked = requests.where(F.col("request").isNotNull())
        done = self.rows().where(F.col("raw").isNotNull()).select("request")
        return asked.join(done, "request", "left_anti").dropDuplicates(["request"])

    def answer(self, requests: DataFrame, scorer, partitions: int | None = None, slices: int = SLICES) -> dict:
        """Calls for what ``todo`` finds, slice by slice, and appends it. Returns the run's id and how many requests it sent.

        ``requests`` has request, service_id and text; several rows may share a request."""
        run = uuid.uuid4().hex
        # Written first: the slices then read their own part, and not the sources again.
        todo = self.todo(requests.select("request", "service_id", "text"))
        folder = scratch.folder(self.spark, "todo")
        todo.withColumn("slice", F.pmod(F.xxhash64("request"), F.lit(slices)).cast("int")).write.partitionBy("slice").parquet(folder)
        stored = self.spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in todo.dtypes)}, slice int").parquet(folder)
        sent = 0
        for part in sorted(r["slice"] for r in stored.select("slice").distinct().collect()):  # at most ``slices`` rows
            own = stored.where(F.col("slice") == part).drop("slice")
            got = score_python(own, scorer.client, "text", partitions, out_col="raw", error_col="error", per_second=getattr(scorer, "per_second", 0.0))
            got = got.select("request", "service_id", "raw", "error", F.lit(run).alias("run"), F.current_timestamp().alias("answered_at"))
            got.write.mode("append").parquet(self.path)
            sent += own.count()
        return {"run": run, "sent": sent}


def answered(df: DataFrame, ledger: Ledger, scorer, text_col: str, key_col: str = "service_id", out_col: str = "raw",
             error_col: str = "error", partitions: int | None = None, slices: int = SLICES) -> DataFrame:
    """``df`` with its answers from the ledger, after calls for those that lacked one. NULL texts have neither answer nor error."""
    keyed = df.withColumn("_request", request(scorer, F.col(key_col), F.col(text_col)))
    asked = keyed.select(F.col("_request").alias("request"), F.col(key_col).cast("long").alias("service_id"), F.col(text_col).alias("text"))
    ledger.answer(asked, scorer, partitions, slices)
    got = ledger.outcomes().select(F.col("request").alias("_request"), F.col("raw").alias(out_col), F.col("error").alias(error_col))
    return keyed.join(got, "_request", "left").drop("_request")
