"""Keyed table maintenance: appends, merges, deletes and table status.

Parquet tables do not support MERGE or DELETE, so every change is a new
DataFrame (anti/semi joins + union) written to a fresh table and swapped in.
The joins are written so that a small batch against a big table never
shuffles the big table: the batch's keys are the build side, which AQE
broadcasts when its runtime size is under the broadcast threshold (a checked
bound); above it the same plan runs as a sort-merge join.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..constants import SAMPLE_TABLES


def _keys_not_null(keys: list[str]):
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def merge_insert_only(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Insert update rows whose key is not in the target; matched target rows
    stay untouched. NULL keys never match, so such update rows are inserted.

    The target's keys are first cut down to the batch's (a semi-join, with the
    batch as the build side); the batch is then anti-joined against what is
    left, which is never larger than the batch's keys. So a small batch never
    moves the target."""
    matched = target.select(*keys).join(updates.select(*keys), keys, "left_semi").distinct()
    new_rows = updates.join(matched, keys, "left_anti")
    return target.unionByName(new_rows.select(*target.columns))


def repeated_keys(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Non-NULL keys that the batch has more than once: a count over the keys alone."""
    return (updates.filter(_keys_not_null(keys)).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))


def merge_upsert(target: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Matched keys take the update row, new keys are inserted. The batch
    must have unique keys (raises otherwise).

    The batch is read twice: once for its rows, once for its keys, counted in a
    hash aggregation that raises on a repeat and is the anti-join's build side.
    NULL keys match nothing and are inserted."""
    counted = (updates.filter(_keys_not_null(keys)).groupBy(*keys)
               .agg(F.count(F.lit(1)).alias("_n")))
    checked = counted.filter(F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate key in merge source"))
                                    .cast("boolean")).otherwise(F.lit(True))).select(*keys)
    kept = target.join(checked, keys, "left_anti")
    return kept.unionByName(updates.select(*target.columns))


def delete_by_keys(target: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """Remove rows whose key is in ``doomed``; a NULL key is never deleted."""
    return target.join(doomed.select(*keys), keys, "left_anti")


def reconciled(df: DataFrame, stored: T.StructType) -> DataFrame:
    """``df`` with the columns of a stored schema, by name whatever the case, in
    its order. Columns it lacks are NULL; one that the table doesn't have, or of
    another type, is an error."""
    own = {f.name.lower(): f for f in df.schema.fields}
    if len(own) < len(df.columns):
        raise ValueError("two columns have one name")
    known = {f.name.lower(): f for f in stored.fields}
    extra = [f.name for k, f in own.items() if k not in known]
    drift = [f"{f.name} is {own[k].dataType.simpleString()}, stored as {f.dataType.simpleString()}" for k, f in known.items() if k in own and not _same_type(own[k].dataType, f.dataType)]
    if extra or drift:
        raise ValueError("; ".join(["columns the table doesn't have: " + ", ".join(extra)] * bool(extra) + drift))
    return df.select(*[(F.col(f"`{own[k].name}`") if k in own else F.lit(None).cast(f.dataType)).alias(f.name) for k, f in known.items()])


def _same_type(a: T.DataType, b: T.DataType) -> bool:
    """Alike but for what may be NULL inside."""
    return a.simpleString().lower() == b.simpleString().lower()


def append(df: DataFrame, path: str) -> None:
    """S8, S9: appends to a Parquet folder, in the columns it has already (``reconciled``); a new folder takes them as they are."""
    try:
        stored = df.sparkSession.read.parquet(path).schema
    except AnalysisException:
        stored = None
    (df if stored is None else reconciled(df, stored)).write.mode("append").parquet(path)


def _put_back(spark: SparkSession, name: str) -> None:
    """After a crash between two renames the old rows are in ``<name>__last``: they get their name again."""
    last = beside(name, "last")
    if spark.catalog.tableExists(last) and not spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {last} RENAME TO {name}")


def beside(name: str, what: str) -> str:
    """``db.table`` -> ``db.table__what``, within the quotes of the last part if it has any."""
    return f"{name[:-1]}__{what}`" if name.endswith("`") else f"{name}__{what}"


def _swap(spark: SparkSession, name: str, new: str) -> None:
    last = beside(name, "last")
    spark.sql(f"DROP TABLE IF EXISTS {last}")
    if spark.catalog.tableExists(name):
        spark.sql(f"ALTER TABLE {name} RENAME TO {last}")
    spark.sql(f"ALTER TABLE {new} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {last}")


def replace_table(spark: SparkSession, name: str, df: DataFrame) -> None:
    """Overwrite a catalog table with ``df`` even when ``df`` reads it: the
    new table is written beside it, the old one is set aside by a rename, and
    goes only when the new one is in place. After a crash between the two
    renames the next call puts the old rows back first."""
    _put_back(spark, name)
    new = beside(name, "next")
    spark.sql(f"DROP TABLE IF EXISTS {new}")
    df.write.mode("overwrite").saveAsTable(new)
    _swap(spark, name, new)


#: How staged tables are stored: their texts have much in common from row to row, which this codec finds and Snappy
#: doesn't. A smaller file holds more rows, so row groups are smaller too.
STORED = {"compression": "zstd", "parquet.page.size": str(4 << 20), "parquet.block.size": str(32 << 20)}

_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame | Iterable[DataFrame], folder: str, level: int = 3) -> str:
    """Writes ``df`` to a fresh folder below ``folder``, which no table shows yet.

    Several frames are written one after the other. The shuffle files of each
    write are removed when it ends, so that they don't lie beside the next one's;
    a frame that is used again afterwards shuffles again. ``level`` is the codec's:
    3 takes about Snappy's time, and higher ones more of it for less room."""
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    options = {**STORED, "parquet.compression.codec.zstd.level": str(level)}
    for part in [df] if isinstance(df, DataFrame) else df:
        with _set(part.sparkSession, {_FILE_CLEANUP: "true"}):
            # A frame keeps the setting it was made under.
            part.select("*").write.options(**options).mode("append").parquet(path)
    return path


def switch(spark: SparkSession, name: str, path: str) -> None:
    """Makes a table show the rows of a staged folder, by one change of its
    location: a reader sees the old rows or the new ones. A table whose columns
    change is swapped by renames instead, and put back first after a crash
    between them. Old folders stay, for readers still on them (``clean``)."""
    _put_back(spark, name)
    schema = spark.read.parquet(path).schema
    columns = lambda s: [(f.name, f.dataType) for f in s.fields]
    if not spark.catalog.tableExists(name):
        spark.catalog.createTable(name, path, "parquet", schema)
    elif columns(spark.table(name).schema) == columns(schema):
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{path.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}'")
        spark.catalog.refreshTable(name)
    else:
        new = beside(name, "next")
        spark.sql(f"DROP TABLE IF EXISTS {new}")
        spark.catalog.createTable(new, path, "parquet", schema)
        _swap(spark, name, new)


def publish(spark: SparkSession, name: str, df: DataFrame, folder: str) -> str:
    """S5, S6: overwrite or create a table; ``df`` may read it. If the write
    fails, the table shows what it showed before."""
    path = stage(df, folder)
    switch(spark, name, path)
    return path


def location(spark: SparkSession, name: str) -> str:
    """The folder that a table shows."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def clean(spark: SparkSession, name: str, folder: str, keep: int = 1) -> list[str]:
    """Removes folders staged below ``folder`` that the table ``name`` doesn't show,
    but for the ``keep`` newest ones (readers may still be on them). Returns their names.

    Call it between runs: a folder that is staged and not yet switched to counts as one of the others."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    shown = location(spark, name).rstrip("/").rsplit("/", 1)[-1]
    old = sorted((x.getModificationTime(), x.getPath().getName()) for x in fs.listStatus(top) if x.isDirectory())
    gone = [n for _, n in old if n != shown][:-keep or None]
    for n in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(top, n), True)
    return gone


def create_if_missing(spark: SparkSession, database: str, tables: dict) -> list[str]:
    """S7: the database and each missing table of (name -> schema); existing
    tables stay as they are. Returns the names created."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    made = []
    for name, schema in tables.items():
        if not spark.catalog.tableExists(f"{database}.{name}"):
            spark.createDataFrame([], schema).write.saveAsTable(f"{database}.{name}")
            made.append(name)
    return made


def present_tables(spark: SparkSession, database: str, expected: list[str] = SAMPLE_TABLES) -> dict[str, DataFrame | None]:
    """P6: the expected tables of a database, found whatever the case of its
    name or theirs; a missing one (or a missing database) is None."""
    found = next((d.name for d in spark.catalog.listDatabases() if d.name.lower() == database.lower()), None)
    names = {t.name.lower(): t.name for t in spark.catalog.listTables(found)} if found else {}
    return {t: spark.table(f"{found}.{names[t.lower()]}") if t.lower() in names else None for t in expected}


def table_status(spark: SparkSession, tables: dict[str, DataFrame | None],
                 expected: list[str] = SAMPLE_TABLES) -> DataFrame:
    """Row count of each expected table (NULL when missing) and ``ready``:
    every expected table present and non-empty."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
              for name, df in tables.items() if df is not None and name in expected]
    exp = spark.createDataFrame([(t, i) for i, t in enumerate(expected)],
                                "table_name string, ord int")
    joined = exp.join(F.broadcast(_union_all(counts)), "table_name", "left") if counts else \
        exp.withColumn("n", F.lit(None).cast("long"))
    everything = Window.partitionBy()  # over the few expected names only
    ready = F.min(F.coalesce(F.col("n"), F.lit(0)) > 0).over(everything)
    return joined.select("table_name", "n", ready.alias("ready"))


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]):
    """Settings of the session that hold inside the block."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def from_footers(spark: SparkSession):
    """Inside this block Parquet counts come from the files' footers: no column is read.

    That is the newer file source with aggregates pushed down."""
    v1 = spark.conf.get("spark.sql.sources.useV1SourceList").split(",")
    return _set(spark, {"spark.sql.sources.useV1SourceList": ",".join(x for x in v1 if x != "parquet"), "spark.sql.parquet.aggregatePushdown": "true"})


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """The number of rows of a Parquet folder (``n``); within ``from_footers`` it costs no scan."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


def stored_status(spark: SparkSession, paths: dict[str, str | None], expected: list[str] = SAMPLE_TABLES) -> DataFrame:
    """``table_status`` of stored tables, counted from their footers; a missing folder (or None) is NULL."""
    counts: dict[str, int | None] = {}
    with from_footers(spark):
        for name in expected:
            try:
                counts[name] = row_count(spark, paths[name]).first()["n"] if paths.get(name) else None
            except AnalysisException:
                counts[name] = None
    ready = all((n or 0) > 0 for n in counts.values())
    return spark.createDataFrame([(t, n, ready) for t, n in counts.items()], "table_name string, n long, ready boolean")


def _union_all(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out
