"""What a full run leaves on disk: small tables, no shuffle files of the steps behind it, emails drafted share by share."""
import os
import time

import pytest
from pyspark.sql import functions as F

from service_insights.operators import outreach
from service_insights.plans import pipelines
from service_insights.sources import fixtures, registry

from conftest import SF001

CFG = pipelines.seed_configs()["all_components"]


@pytest.fixture()
def database(spark):
    name = "disk_test"
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def size(path):
    return sum(os.path.getsize(os.path.join(d, x)) for d, _, names in os.walk(path) for x in names if x.endswith(".parquet"))


def shuffle_files(spark):
    """Bytes by name."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    all_ = [files.apply(i) for i in range(files.size())]
    return {f.getName(): f.length() for f in all_ if f.getName().startswith("shuffle_")}


def rows(df):
    return sorted(map(str, df.collect()))


def test_tables_are_small_and_the_shuffles_are_gone(spark, tmp_path, database):
    sources = fixtures.service(spark, SF001), fixtures.vehicle(spark, SF001), fixtures.customer(spark, SF001)
    before = shuffle_files(spark)
    out = pipelines.full_run(spark, *sources, CFG, str(tmp_path / "run"), database=database)
    written = {what: registry.location(spark, out[what]).removeprefix("file:") for what in ("answers", "recommendations", "emails")}
    left = None
    for _ in range(50):  # Spark removes them in the background
        left = sum(n for name, n in shuffle_files(spark).items() if name not in before)
        if left < 10_000:
            break
        time.sleep(0.1)
    assert left < 10_000  # a row a task of the jobs that only count
    for what, least in (("answers", 2.5), ("recommendations", 2.5), ("emails", 1.5)):
        spark.table(out[what]).write.option("compression", "snappy").parquet(str(tmp_path / what))
        assert size(str(tmp_path / what)) > least * size(written[what]), what
    findings = outreach.urgent_findings(spark.table(out["recommendations"]), *sources[1:])
    assert rows(spark.table(out["emails"]).drop("error")) == rows(outreach.followup_emails(findings))


def test_shares_hold_each_visit_once(spark):
    """Repeated visits, NULL keys and reasons, a vehicle with many visits, and vehicles whose ids have another type."""
    recs = spark.range(400).selectExpr(
        "if(id % 50 = 7, null, id div 2) AS service_id", "if(id % 3 = 0, 1, if(id % 60 = 11, null, id % 40)) AS vehicle_id",
        "concat('c', id % 3) AS component_key", "if(id % 5 = 0, 'Good', if(id % 31 = 0, null, 'Urgent')) AS classification",
        "if(id % 13 = 0, null, concat('r', id)) AS reasoning").repartition(5)
    customer = spark.createDataFrame([(k, "First", "Last", "m@x") for k in range(4)], "customer_id long, first_name string, last_name string, email string")
    for kind in ("long", "int"):
        vehicle = spark.createDataFrame([(k, k % 4, "Make", f"M{k}") for k in [*range(38), 3]], f"vehicle_id {kind}, customer_id int, make string, model string")
        whole = rows(outreach.urgent_findings(recs, vehicle, customer))
        for n in (1, 4):
            shares = [rows(part) for part in outreach.urgent_findings_in_slices(recs, vehicle, customer, n)]
            assert len(shares) == n and all(shares) and sorted(sum(shares, [])) == whole
            assert sum(any("vehicle_id=1," in r for r in s) for s in shares) == 1


def test_a_stage_of_several_frames(spark, tmp_path):
    """One job after the other, each without what the one before it shuffled; an empty frame has its columns."""
    seen = []

    def parts():
        for i in range(3):
            seen.append(len(shuffle_files(spark).keys() - before.keys()))
            yield spark.range(1000).where(f"id % 3 = {i}").groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n"))
            time.sleep(1)  # Spark removes them in the background

    before = shuffle_files(spark)
    path = registry.stage(parts(), str(tmp_path))
    assert spark.read.parquet(path).agg(F.sum("n")).first()[0] == 1000 and seen == [0, 0, 0]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    none = registry.stage(iter([spark.range(0)]), str(tmp_path))
    assert spark.read.parquet(none).columns == ["id"] and spark.read.parquet(none).count() == 0
