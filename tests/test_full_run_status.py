"""A full run counts what became of its answers on the way to the recommendations, without parsing them again."""
import json

import pytest
from pyspark.sql import functions as F

from service_insights.operators import assess, scoring
from service_insights.plans import pipelines

CFG = pipelines.seed_configs()["balanced"]


@pytest.fixture()
def database(spark):
    name = "status_test"
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def service(spark, n):
    texts = F.element_at(F.array(*[F.lit(t) for t in ("good", "prose", "empty", "none")]), (F.col("id") % 4 + 1).cast("int"))
    return spark.range(n).select(F.col("id").alias("service_id"), F.lit(1).cast("long").alias("vehicle_id"), F.when(F.col("id") % 9 != 8, texts).alias("service_performed"),
                                 F.lit(None).cast("array<string>").alias("flagged_components")).repartition(3)


def endpoint():
    """Its transport is local to this function, so that the tasks get it by value."""
    one = [{"component": "tires", "classification": "Urgent", "reasoning": "worn"}]
    texts = {"good": json.dumps({"assessments": one}), "prose": "The tires look worn.", "empty": '{"assessments": []}'}

    def send(body):
        return {"choices": [{"message": {"content": texts[body["messages"][0]["content"].rsplit("\n", 1)[-1]]}}]}  # none: no such text, a failed call

    return scoring.EndpointScorer("u", "m", transport=send, retries=1)


@pytest.mark.parametrize("n", [0, 90])
def test_outcomes_are_counted_while_the_answers_are_parsed(spark, database, tmp_path, monkeypatch, n):
    rows = service(spark, n)
    want = {r["w"]: r["count"] for r in rows.where("service_performed is not null").select(F.col("service_performed").alias("w")).groupBy("w").count().collect()}
    names = {"good": "ok", "prose": "unparsed", "empty": "empty", "none": "no_answer"}
    vehicle = spark.createDataFrame([(1, 2, "Make", "Model")], "vehicle_id long, customer_id long, make string, model string")
    customer = spark.createDataFrame([(2, "First", "Last", "m@x")], "customer_id long, first_name string, last_name string, email string")
    monkeypatch.setattr(assess, "parse_status", lambda *_: pytest.fail("the answers are parsed for the counts alone"))
    out = pipelines.full_run(spark, rows, vehicle, customer, CFG, str(tmp_path), endpoint(), partitions=2, database=database, max_failed=1.0, slices=2)
    assert out["status"] == {names[k]: v for k, v in want.items()}
    assert out["n_recommendations"] == out["n_emails"] == want.get("good", 0)
