"""Stored configs and runs, table maintenance, order at the edge."""
import pytest
from pyspark.sql import functions as F

from service_insights import schemas
from service_insights.plans import pipelines
from service_insights.sources import catalog, registry

CFG = pipelines.seed_configs()


@pytest.fixture()
def database(spark):
    name = "catalog_test"
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def test_config_round_trip(spark, tmp_path):
    path = str(tmp_path / "configs")
    ids = []
    for name in ("first", "it's; --"):
        config_id, row = catalog.new_config_row(spark, name, "model", [{"component_key": "tires"}])
        catalog.append_config(path, row)
        ids.append(config_id)
    spark.read.parquet(path).createOrReplaceTempView("stored_configs")
    got = catalog.lookup_config(spark, "stored_configs", ids[1])
    assert got["name"] == "it's; --" and got["components"] == [{"component_key": "tires"}]
    with pytest.raises(KeyError):
        catalog.lookup_config(spark, "stored_configs", "' OR 1 = 1 --")


def test_runs_are_appended(spark, tmp_path):
    rows = spark.createDataFrame([(None, "tires", "Good", "r", "notes"), (5, "ac", None, None, "n")],
                                 "service_id long, component_key string, classification string, reasoning string, service_performed string")
    one = pipelines.persist_run(spark, rows, str(tmp_path), CFG["balanced"], 50)
    two = pipelines.persist_run(spark, rows, str(tmp_path), CFG["balanced"], None)
    runs = {r.run_id: r for r in spark.read.parquet(f"{tmp_path}/runs").collect()}
    assert set(runs) == {one, two} and runs[one].row_count == 50 and runs[two].row_count == 0
    results = spark.read.parquet(f"{tmp_path}/run_results")
    assert results.columns == ["run_id", "service_id", "component_key", "classification", "reasoning"]
    assert sorted(r.service_id for r in results.filter(F.col("run_id") == one).collect()) == [0, 5]


def test_create_replace_and_presence(spark, database):
    tables = {"components": schemas.COMPONENTS, "Configs": schemas.CONFIGS}
    assert registry.create_if_missing(spark, database, tables) == ["components", "Configs"]
    assert registry.create_if_missing(spark, database, tables) == []
    name = f"{database}.components"
    registry.replace_table(spark, name, catalog.seed_components(spark))
    registry.replace_table(spark, name, spark.table(name).filter("component_key <> 'ac'"))  # reads what it replaces
    assert spark.table(name).count() == 11
    # a crash between the renames: the old rows are put back first
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}__last")
    registry.replace_table(spark, name, catalog.seed_components(spark).limit(3))
    assert spark.table(name).count() == 3
    found = registry.present_tables(spark, database.upper(), ["COMPONENTS", "configs", "service"])
    assert found["COMPONENTS"].count() == 3 and found["configs"].count() == 0 and found["service"] is None
    assert registry.present_tables(spark, "no_such_database", ["service"]) == {"service": None}
    status = {r.table_name: (r.n, r.ready) for r in registry.table_status(spark, found, ["COMPONENTS", "configs", "service"]).collect()}
    assert status == {"COMPONENTS": (3, False), "configs": (0, False), "service": (None, False)}


def test_upsert_raises_on_repeats_and_keeps_null_keys(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    u = spark.createDataFrame([(2, "B"), (None, "m"), (None, "o")], "k long, v string")
    assert sorted(map(str, registry.merge_upsert(t, u, ["k"]).collect())) == sorted(map(str, [
        *t.filter("k is null or k = 1").collect(), *u.collect()]))
    with pytest.raises(Exception, match="duplicate key"):
        registry.merge_upsert(t, u.union(u), ["k"]).collect()
    assert [r.k for r in registry.repeated_keys(u.union(u), ["k"]).collect()] == [2]


def test_order_at_the_edge(spark):
    df = spark.createDataFrame([(2, "b"), (None, "a"), (1, None), (1, "c")], "service_id long, component_key string")
    assert [tuple(r) for r in pipelines.in_order(df).collect()] == [(None, "a"), (1, None), (1, "c"), (2, "b")]
