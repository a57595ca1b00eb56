"""Derived tables at sf0.01 against the numbers checked in two engines."""
from pyspark.sql import functions as F

from service_insights.operators import assess, compare
from service_insights.plans import pipelines
from service_insights.sources import fixtures

from conftest import SF001

CFG = pipelines.seed_configs()


def test_service_counts(spark):
    s = fixtures.service(spark, SF001)
    assert s.count() == 45832
    assert s.filter(F.col("flagged_components").isNotNull()).count() == 39238
    assert s.filter(F.col("service_performed") == "").count() == 6594


def test_tires_brakes_numbers(spark):
    rows = assess.with_status(pipelines.run_config(fixtures.service(spark, SF001), CFG["balanced"], None))
    got = {(r.component_key, r.classification): r.n for r in
           rows.groupBy("component_key", "classification").agg(F.count("*").alias("n")).collect()}
    assert got == {("tires", "Urgent"): 13344, ("tires", "Upcoming"): 15519, ("tires", "Good"): 16969,
                   ("brakes", "Urgent"): 6516, ("brakes", "Upcoming"): 9875, ("brakes", "Good"): 29441}
    catches = {r.component_key: r.n for r in rows.filter("ai_catch").groupBy("component_key")
               .agg(F.count("*").alias("n")).collect()}
    assert catches == {"tires": 26598, "brakes": 16391}


def test_strict_differences(spark):
    cmp = pipelines.compare_configs(fixtures.service(spark, SF001), CFG["balanced"], CFG["strict"], None)
    got = {r.component_key: r.n for r in compare.diffs_only(cmp).groupBy("component_key")
           .agg(F.count("*").alias("n")).collect()}
    assert got == {"tires": 11967, "brakes": 4846}


def test_urgent_tires_or_brakes_joined_to_customer(spark):
    from service_insights.operators import outreach
    recs = pipelines.recommendations(fixtures.service(spark, SF001), CFG["balanced"])
    found = outreach.urgent_findings(recs, fixtures.vehicle(spark, SF001), fixtures.customer(spark, SF001))
    assert found.count() == 18010
