"""The answer ledger: a broken run resumed, refused calls tried again, drafts, and tables switched by location."""
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from service_insights.operators import ledger, outreach, scoring
from service_insights.plans import pipelines
from service_insights.sources import registry

CFG = pipelines.seed_configs()["balanced"]
COLUMNS = "service_id long, vehicle_id long, service_performed string, flagged_components array<string>"
ROWS = [(k, k % 7, f"note {k % 40}", None) for k in range(120)] + [(None, 1, "no id", []), (None, 1, "no id", []), (7, 0, "note 7", None), (500, 2, None, ["tires"])]
#: Requests of ROWS: equal rows share one, rows without notes have none.
REQUESTS = 121


def transport(folder, refuse=None, pause=None):
    """Notes each call in a file of its own name; ``refuse`` (a text) marks notes whose call fails."""
    def send(body):
        note = body["messages"][0]["content"].rsplit("\n", 1)[-1]
        with open(os.path.join(folder, f"{os.getpid()}.log"), "a") as f:
            f.write(f"{time.time()} {note}\n")
        if refuse is not None and refuse in note:
            raise ClientError("400 no")
        if pause and not os.path.exists(os.path.join(folder, f"{os.getpid()}.paused")):
            open(os.path.join(folder, f"{os.getpid()}.paused"), "w").close()
            raise Throttled("429", pause)
        return {"choices": [{"message": {"content": json.dumps({"assessments": [{"component": "tires", "classification": "Urgent", "reasoning": note}]})}}]}

    ClientError, Throttled = scoring.ClientError, scoring.Throttled
    return send


def calls(folder):
    lines = [x.split(" ", 1) for name in os.listdir(folder) if name.endswith(".log") for x in open(os.path.join(folder, name))]
    return sorted((float(t), note.strip()) for t, note in lines)


def endpoint(folder, **more):
    return scoring.EndpointScorer("u", "m", transport=transport(str(folder), **more), retries=2)


@pytest.fixture()
def database(spark):
    name = "ledger_test"
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
    spark.sql(f"CREATE DATABASE {name}")
    yield name
    spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")


@pytest.fixture()
def folders(tmp_path):
    out = {k: str(tmp_path / k) for k in ("calls", "drafts", "out", "other")}
    for path in out.values():
        os.mkdir(path)
    return out


def tables(spark):
    vehicle = spark.createDataFrame([(k, 10 + k, "Make", "Model") for k in range(7)], "vehicle_id long, customer_id long, make string, model string")
    customer = spark.createDataFrame([(10 + k, "First", f"Last{k}", "m@x") for k in range(7)], "customer_id long, first_name string, last_name string, email string")
    return spark.createDataFrame(ROWS, COLUMNS).repartition(3), vehicle, customer


def stored_tables(spark, database):
    return [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]


def published(spark, out):
    return [sorted(map(str, spark.table(out[k]).collect())) for k in ("answers", "recommendations", "emails")]


def test_a_killed_run_goes_on(spark, folders, database, monkeypatch):
    """Killed after some slices, then run again: each request is sent once in total, and the tables are those of an unbroken run."""
    service, vehicle, customer = tables(spark)
    run = lambda d, out: pipelines.full_run(spark, service, vehicle, customer, CFG, out, endpoint(d), partitions=2, database=database, slices=5)
    whole, slices = ledger.score_python, []

    def dies(*args, **kwargs):
        slices.append(1)
        if len(slices) == 3:
            raise KeyboardInterrupt
        return whole(*args, **kwargs)

    monkeypatch.setattr(ledger, "score_python", dies)
    with pytest.raises(KeyboardInterrupt):
        run(folders["calls"], folders["out"])
    before = len(calls(folders["calls"]))
    assert 0 < before < REQUESTS and not stored_tables(spark, database)
    monkeypatch.setattr(ledger, "score_python", whole)
    got = published(spark, run(folders["calls"], folders["out"]))
    assert len(calls(folders["calls"])) == REQUESTS
    spark.sql(f"DROP DATABASE {database} CASCADE")
    spark.sql(f"CREATE DATABASE {database}")
    assert got == published(spark, run(folders["drafts"], folders["other"]))
    assert len(got[0]) == len(ROWS) and len(got[1]) == len(ROWS) - 1


def test_refused_calls_are_sent_again_and_no_others(spark, folders, database):
    service, vehicle, customer = tables(spark)
    run = lambda **more: pipelines.full_run(spark, service, vehicle, customer, CFG, folders["out"], endpoint(folders["calls"], **more), partitions=2, database=database, slices=2)
    bad = sum("note 3" in (r[2] or "") for r in ROWS)  # note 3 and notes 30 to 39
    with pytest.raises(RuntimeError, match=f"{bad} of {len(ROWS) - 1} calls gave no answer; nothing was published"):
        run(refuse="note 3")
    assert not stored_tables(spark, database) and len(calls(folders["calls"])) == REQUESTS
    out = run()
    again = calls(folders["calls"])[REQUESTS:]
    assert len(again) == bad and all("note 3" in note for _, note in again)
    assert out["status"] == {"ok": len(ROWS) - 1} and out["n_recommendations"] == len(ROWS) - 1


def test_limit_of_failures_publishes_the_rest(spark, folders, database):
    service, vehicle, customer = tables(spark)
    out = pipelines.full_run(spark, service, vehicle, customer, CFG, folders["out"], endpoint(folders["calls"], refuse="note 39"), partitions=2, database=database, max_failed=0.05, slices=2)
    rows = spark.table(out["answers"])
    assert rows.where("error = 'refused: 400 no' and raw is null").count() == 3 and out["status"]["no_answer"] == 3
    assert rows.where("service_performed is null and raw is null and error is null").count() == 1


def test_changed_prompt_is_another_request(spark, folders):
    text, key = F.lit("x"), F.lit(1)
    one, two = scoring.EndpointScorer("u", "m", prompt="a"), scoring.EndpointScorer("u", "m", prompt="b")
    got = spark.range(1).select(ledger.request(one, key, text), ledger.request(one, key, text), ledger.request(two, key, text), ledger.request(one, F.lit(2), text),
                                ledger.request(one, key, F.lit(None).cast("string"))).first()
    assert got[0] == got[1] and len({got[0], got[2], got[3]}) == 3 and got[4] is None


def test_dead_drafter_publishes_nothing(spark, folders, database):
    service, vehicle, customer = tables(spark)
    run = lambda drafter, **more: pipelines.full_run(spark, service, vehicle, customer, CFG, folders["out"], endpoint(folders["calls"]), drafter, partitions=2, database=database, slices=2, **more)
    good = run(endpoint(folders["drafts"]))
    emails = published(spark, good)[2]
    n = len(calls(folders["drafts"]))
    assert good["failed_drafts"] == 0 and n == len({str(r) for r in emails}) <= len(emails)
    dead = scoring.text_drafter("u", "dead", transport=transport(folders["other"], refuse=""), retries=1)
    with pytest.raises(RuntimeError, match="drafts gave no answer; nothing was published"):
        run(dead)
    assert published(spark, good)[2] == emails
    out = run(dead, max_failed=1.0)
    rows = spark.table(out["emails"])
    assert out["failed_drafts"] == rows.where("custom_email is null and error like 'refused%'").count() == rows.count()
    assert len(calls(folders["calls"])) == REQUESTS and len(calls(folders["drafts"])) == n


def test_drafts_carry_their_errors(spark, folders):
    findings = spark.createDataFrame([(1, 2, 3, "A", "B", "e", "Make", "Model", "tires: worn"), (2, 2, 3, None, "B", "e", "Make", "Model", "x")],
                                     "service_id long, vehicle_id long, customer_id long, first_name string, last_name string, email string, make string, model string, urgent_reasons string")
    dead = scoring.text_drafter("u", "dead", transport=transport(folders["other"], refuse=""), retries=1)
    got = {r.service_id: (r.custom_email, r.error) for r in outreach.followup_emails(findings, dead, error_col="error").collect()}
    assert got == {1: (None, "refused: 400 no"), 2: (None, None)}
    assert {r.error for r in outreach.followup_emails(findings, error_col="error").collect()} == {None}


def test_failed_write_leaves_the_old_rows(spark, folders, database):
    name = f"{database}.t"
    registry.publish(spark, name, spark.range(5), folders["out"])
    broken = spark.range(10).select(F.when(F.col("id") > 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        registry.publish(spark, name, broken, folders["out"])
    assert spark.table(name).count() == 5
    first = registry.location(spark, name)
    registry.publish(spark, name, spark.table(name).where("id > 2"), folders["out"])  # reads what it replaces
    assert sorted(r.id for r in spark.table(name).collect()) == [3, 4] and registry.location(spark, name) != first
    assert spark.read.parquet(first).count() == 5  # a reader of the old rows still has them
    registry.publish(spark, name, spark.range(3).selectExpr("id AS other", "'x' AS more"), folders["out"])  # other columns
    assert spark.table(name).columns == ["other", "more"] and spark.table(name).count() == 3
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}__last")  # a crash between the renames
    registry.publish(spark, name, spark.range(2).selectExpr("id AS other", "'y' AS more"), folders["out"])
    assert spark.table(name).count() == 2


def test_old_folders_go_but_the_newest(spark, folders, database):
    name = f"{database}.t"
    paths = [registry.publish(spark, name, spark.range(k), folders["out"]) for k in range(5)]
    names = [p.rsplit("/", 1)[-1] for p in paths]
    assert sorted(registry.clean(spark, name, folders["out"])) == sorted(names[:3])
    assert sorted(os.listdir(folders["out"])) == sorted(names[3:]) and spark.table(name).count() == 4
    assert registry.clean(spark, name, folders["out"], keep=0) == [names[3]] and registry.clean(spark, name, folders["out"]) == []


def test_budget_holds_over_all_tasks(spark, folders):
    """40 calls at 20 a second in 8 tasks: never more than the budget since the first task began, but for the start of a second."""
    df = spark.range(40).selectExpr("id AS service_id", "concat('n ', id) AS service_performed")
    s = scoring.EndpointScorer("budget", "m", transport=transport(folders["calls"]), per_second=20.0, concurrency=4)
    t0 = time.time()
    assert scoring.score_python(df, s.client, partitions=8, per_second=s.per_second).where("raw is not null").count() == 40
    at = [t for t, _ in calls(folders["calls"])]
    assert len(at) == 40 and at[0] > t0
    slots = scoring.task_slots(spark, 8)
    for k, t in enumerate(at):
        assert sum(t <= u < t + 1 for u in at[k:]) <= 20 + slots
    assert at[-1] - at[0] >= 39 / 20 - slots / 20 - 0.2


def test_pause_is_honoured(folders, monkeypatch):
    s = scoring.EndpointScorer("pause", "m", transport=transport(folders["calls"], pause=0.6), concurrency=1)
    call = s.client()
    assert all(e is None for _, e in call(["a", "b"]))
    call.close()
    at = [t for t, _ in calls(folders["calls"])]
    assert len(at) == 3 and at[1] - at[0] >= 0.55
    assert scoring.retry_after("7") == 7 and scoring.retry_after("soon") is None and scoring.retry_after(None) is None
    assert scoring.retry_after("Thu, 01 Jan 1970 00:01:40 GMT", now=40) == 60
    long = scoring.EndpointScorer("pause", "m", transport=transport(folders["other"], pause=9.0), max_pause=1.0, retries=3)
    t0 = time.time()
    assert long.client()(["a"])[0][1].startswith("failed: Throttled") and time.time() - t0 < 5


def test_slots(spark):
    assert scoring.task_slots(spark, 3) == min(3, spark.sparkContext.defaultParallelism)
    assert scoring.task_slots(spark) == spark.sparkContext.defaultParallelism
