"""The model path with an injected transport: request bodies, ids, errors, the full run."""
import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from service_insights.constants import EMAIL_OPTIONS, NOTES_SEPARATOR
from service_insights.operators import scoring
from service_insights.plans import pipelines
from service_insights.sources import fixtures

from conftest import SF0001

CFG = pipelines.seed_configs()
ONE = {"assessments": [{"component": "tires", "classification": "Urgent", "reasoning": "worn"}]}


def answer(text):
    return {"choices": [{"message": {"content": text}}]}


def echo(body):
    """An endpoint that answers with the request itself."""
    return answer(json.dumps(body))


def urgent():
    """Nested, so that it reaches the workers by value."""
    text = json.dumps(ONE)
    return lambda body: {"choices": [{"message": {"content": text}}]}


def down(body):
    raise OSError("down")


def test_request_body(spark):
    cfg = CFG["all_components"]
    s = scoring.config_scorer(spark, cfg, "http://host/v1", transport=echo)
    (text, error), (none, _) = s.client()(["LF 2", None])
    body = json.loads(text)
    assert error is None and none is None
    assert body["model"] == cfg.model_endpoint
    prompt = body["messages"][0]["content"]
    assert prompt.endswith(NOTES_SEPARATOR + "LF 2") and ", ".join(cfg.keys) in prompt
    assert body["max_tokens"] == 256 * 12 and body["temperature"] == 0.0
    item = body["response_format"]["json_schema"]["schema"]["properties"]["assessments"]["items"]
    assert item["required"] == ["component", "classification", "reasoning"]
    assert item["properties"]["classification"]["enum"] == ["Urgent", "Upcoming", "Good"]
    assert body["response_format"]["json_schema"]["strict"] is True


def test_two_configs_send_two_prompts(spark):
    a, b = (scoring.config_scorer(spark, CFG[k], "u").prompt for k in ("balanced", "all_components"))
    assert a != b and a and b


def test_drafter_sends_the_prompt_alone():
    body = json.loads(scoring.text_drafter("u", "m", transport=echo).client()(["Write to X."])[0][0])
    assert body["messages"][0]["content"] == "Write to X." and "response_format" not in body
    assert {k: body[k] for k in EMAIL_OPTIONS} == EMAIL_OPTIONS


def test_errors_are_told_apart(monkeypatch):
    monkeypatch.setattr(scoring.time, "sleep", lambda s: None)
    text, why = scoring.EndpointScorer("u", "m", transport=down).client()(["x"])[0]
    assert text is None and why.startswith("failed: OSError")
    calls = []

    def once(body):
        calls.append(1)
        raise scoring.ClientError("401 Unauthorized")

    assert scoring.EndpointScorer("u", "m", transport=once).client()(["x"])[0] == (None, "refused: 401 Unauthorized")
    assert len(calls) == 1


def test_ids_pass_untouched_beside_nulls(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, "a"), (None, "b"), (big + 2, None)], "service_id long, service_performed string").coalesce(1)
    rows = scoring.score_python(df, scoring.EndpointScorer("u", "m", transport=urgent()).client, error_col="error").collect()
    assert sorted(r.service_id for r in rows if r.service_id is not None) == [big, big + 2]
    assert {r.service_id: r.raw is None for r in rows} == {big: False, None: False, big + 2: True}


def _tables(spark):
    return fixtures.service(spark, SF0001), fixtures.vehicle(spark, SF0001), fixtures.customer(spark, SF0001)


@pytest.fixture()
def database(spark):
    name = "model_path_test"
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


def test_full_run_keeps_answers_and_publishes(spark, tmp_path, database):
    service, vehicle, customer = _tables(spark)
    cfg = CFG["balanced"]
    acc = spark.sparkContext.accumulator(0)
    scorer = scoring.CannedScorer({}, default=json.dumps(ONE), calls=acc)
    out = pipelines.full_run(spark, service, vehicle, customer, cfg, str(tmp_path), scorer, partitions=4, database=database)
    n = service.count()
    assert acc.value == n == out["n_recommendations"] and out["status"] == {"ok": n}
    assert spark.table(out["answers"]).count() == n
    assert cfg.config_id in out["recommendations"] and out["n_emails"] > 0 == out["failed_drafts"]
    # a model that is down publishes nothing and loses nothing
    with pytest.raises(RuntimeError, match="nothing was published"):
        pipelines.full_run(spark, service, vehicle, customer, cfg, str(tmp_path), scoring.CannedScorer({}), partitions=4, database=database)
    assert spark.table(out["recommendations"]).count() == n
    # run again, it sends nothing
    again = pipelines.full_run(spark, service, vehicle, customer, cfg, str(tmp_path), scorer, partitions=4, database=database)
    assert acc.value == n and again == out
    # rules need no model
    assert pipelines.full_run(spark, service, vehicle, customer, CFG["strict"], str(tmp_path), database=database)["n_recommendations"] == 2 * n


def test_limit_zero_gives_no_rows(spark):
    service = fixtures.service(spark, SF0001)
    assert pipelines.run_config(service, CFG["balanced"], limit=0).count() == 0
    assert pipelines.compare_configs(service, CFG["balanced"], CFG["strict"], limit=0).count() == 0
    assert scoring.sample_partitions(10_000_000) == 32 and scoring.sample_partitions(10_000_000, most=500) == 500


def test_absurd_reading_is_no_reading(spark):
    from service_insights.functions import rules

    notes = "Tread depth (32nds): LF 99999999999, RF 5, LR 6, RR 7."
    df = spark.createDataFrame([(1, notes)], "service_id long, service_performed string")
    r = rules.readings(df).first()
    assert r.tread_lf is None and r.tread_rf == 5


def test_padding_never_cuts(spark):
    from service_insights.functions.lookup import zero_padded

    got = [r[0] for r in spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (7, 123456780, 123456789012)])).alias("k"))
           .select(zero_padded(F.col("k"), 8)).collect()]
    assert got == ["00000007", "123456780", "123456789012"]
    orders = spark.createDataFrame([(123456789, 1), (123456780, 1)], "o_orderkey long, o_custkey long")
    assert len({r.vin for r in fixtures.vehicle_from_orders(orders).collect()}) == 2


def test_arrow_batches_keep_types(spark):
    df = spark.createDataFrame([(1, "a", None)], "service_id long, service_performed string, d date")
    out = scoring.score_python(df, scoring.EndpointScorer("u", "m", transport=urgent()).client)
    assert dict(out.dtypes)["d"] == "date" and out.first().d is None
    assert pa.array([1]).type == pa.int64()
