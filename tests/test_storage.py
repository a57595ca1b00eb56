"""Bucket-wise merges, counts kept by run, bucketed joins, counts from footers, checked appends, faults of answers."""
import json
import os

import pytest
from pyspark.sql import functions as F

from service_insights.operators import assess, outreach, summarize
from service_insights.sources import keyed, registry, run_counts

from conftest import SF0001


def files(path):
    return {(d.rsplit("/", 1)[-1], name) for d, _, names in os.walk(path) for name in names if name.endswith(".parquet")}


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


TARGET = [(k, f"v{k}") for k in range(200)] + [(None, "n"), (None, "m")]


@pytest.fixture()
def table(spark, tmp_path):
    out = keyed.KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=16)
    out.create(spark.createDataFrame(TARGET, "k long, v string").repartition(3))
    return out


@pytest.mark.parametrize("batch", [[(3, "new"), (1000, "x")], [(3, "new")], [(None, "again"), (5, None)], [], [(k, "all") for k in range(200)]])
def test_merges_rewrite_the_touched_buckets_only(spark, table, batch):
    target = spark.createDataFrame(TARGET, "k long, v string")
    updates = spark.createDataFrame(batch, "k long, v string")
    for change, operator in ((table.upsert, registry.merge_upsert), (table.insert_new, registry.merge_insert_only), (table.delete, registry.delete_by_keys)):
        before, rows = files(table.path), registry_rows(table)
        touched = {f"key_bucket={b}" for b in change(updates)}
        want = operator(spark.createDataFrame(rows, "k long, v string"), updates, ["k"])
        assert same(want, table.read())
        after = files(table.path)
        assert {f for f in before if f[0] not in touched} == {f for f in after if f[0] not in touched}
        assert not batch or len(batch) > 2 or len(touched) <= 2
    assert target.count() == len(TARGET)


def registry_rows(table):
    return [tuple(r) for r in table.read().select("k", "v").collect()]


def test_deleting_all_of_a_bucket(spark, table):
    bucket = table.touched(spark.createDataFrame([(7,)], "k long"))[0]
    keys = [r.k for r in table._stored().where(F.col("key_bucket") == bucket).collect()]
    table.delete(spark.createDataFrame([(k,) for k in keys if k is not None], "k long"))
    left = {k for k, _ in registry_rows(table)}
    assert left == {k for k, _ in TARGET} - {k for k in keys if k is not None} and 7 not in left
    table.upsert(spark.createDataFrame([(7, "back")], "k long, v string"))
    assert dict(registry_rows(table))[7] == "back"


def test_a_batch_may_read_the_table_and_have_another_number_type(spark, table):
    table.upsert(table.read().where("k < 3").select(F.col("k").cast("int").alias("k"), F.lit("self").alias("v")))
    got = dict(registry_rows(table))
    assert [got[k] for k in (0, 1, 2, 3)] == ["self", "self", "self", "v3"] and len(got) == 201


def run_rows(spark, seed):
    return spark.range(300).selectExpr(
        f"CASE WHEN (id + {seed}) % 11 = 0 THEN NULL WHEN (id + {seed}) % 13 = 0 THEN '' ELSE concat('c', id % 4) END AS component_key",
        f"CASE WHEN (id * 7 + {seed}) % 9 = 0 THEN NULL ELSE element_at(array('Urgent', 'Upcoming', 'Good', 'odd', ''), cast((id + {seed}) % 5 AS int) + 1) END AS classification",
        f"CASE WHEN id % 6 = 0 THEN NULL ELSE (id + {seed}) % 3 = 0 END AS technician_flagged")


def test_counts_of_added_runs_equal_the_recount(spark, tmp_path):
    path = str(tmp_path / "counts")
    runs = [run_rows(spark, s) for s in range(4)]
    for k, rows in enumerate(runs):
        before = files(path) if k else set()
        run_counts.add(rows, f"r{k}", path)
        assert before <= files(path)  # adding a run leaves the others' files alone
    run_counts.add(run_rows(spark, 99), "r1", path)  # again: its counts are replaced
    runs[1] = run_rows(spark, 99)
    every = runs[0].union(runs[1]).union(runs[2]).union(runs[3])
    for f in (summarize.distribution, summarize.distribution_share, summarize.distribution_pivot, summarize.catch_count):
        assert same(f(every), f(run_counts.read(spark, path), weight="n")), f.__name__
    some = run_counts.read(spark, path, ["r2"])
    assert same(summarize.distribution(runs[2]), summarize.distribution(some, weight="n"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "r2" in plan, plan
    run_counts.add(runs[0].where("false"), "r2", path)
    assert run_counts.read(spark, path, ["r2"]).count() == 0
    # adding reads the run's rows and nothing else
    assert run_counts.counts(runs[0])._jdf.queryExecution().executedPlan().toString().count("Range (") == 1


def test_totals_of_added_comparisons(spark, tmp_path):
    path = str(tmp_path / "pairs")
    compared = spark.range(10).selectExpr("id % 3 = 0 AS differs")
    run_counts.add_comparison(compared, "a", "b", path)
    run_counts.add_comparison(compared.union(compared), "a", "c", path)
    run_counts.add_comparison(compared.limit(5), "a", "b", path)
    assert run_counts.compare_totals(spark, path).first().asDict() == {"total": 25, "disagreements": 8 + compared.limit(5).where("differs").count()}


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    recs = spark.range(400).selectExpr("id AS service_id", "id % 50 AS vehicle_id", "'tires' AS component_key", "if(id % 3 = 0, 'Urgent', 'Good') AS classification", "concat('r', id) AS reasoning")
    vehicle = spark.range(45).selectExpr("id AS vehicle_id", "id % 9 AS customer_id", "'M' AS make", "'T' AS model")
    customer = spark.range(9).selectExpr("id AS customer_id", "'A' AS first_name", "'B' AS last_name", "'e' AS email")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = outreach.urgent_findings(keyed.store_bucketed(recs, "bucketed_recs", "vehicle_id", 4, str(tmp_path / "r")),
                                          keyed.store_bucketed(vehicle, "bucketed_vehicles", "vehicle_id", 4, str(tmp_path / "v")), customer)
        plan = stored._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning(customer_id") == 2, plan
        assert plan.count("Exchange") == 2, plan  # none below the first join, nor below the group-by
        assert same(outreach.urgent_findings(recs, vehicle, customer), stored) and stored.count() == 120
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in ("bucketed_recs", "bucketed_vehicles"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_counts_come_from_footers(spark, tmp_path):
    spark.range(1000).repartition(3).selectExpr("id", "repeat('x', 100) AS pay").write.parquet(str(tmp_path / "t"))
    with registry.from_footers(spark):
        counted = registry.row_count(spark, str(tmp_path / "t"))
        plan = counted._jdf.queryExecution().executedPlan().toString()
        assert "PushedAggregation: [COUNT(*)]" in plan and counted.first()["n"] == 1000, plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false" and "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
    got = {r.table_name: (r.n, r.ready) for r in registry.stored_status(spark, {"service": str(tmp_path / "t"), "vehicle": str(tmp_path / "none")}, ["service", "vehicle", "customer"]).collect()}
    assert got == {"service": (1000, False), "vehicle": (None, False), "customer": (None, False)}
    ready = registry.stored_status(spark, {"customer": f"{SF0001}/customer.parquet"}, ["customer"]).first()
    assert ready.ready and ready.n == spark.read.parquet(f"{SF0001}/customer.parquet").count()


def test_appends_keep_to_the_stored_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    registry.append(spark.createDataFrame([(1, "a", [1])], "run long, name string, list array<long>"), path)
    registry.append(spark.createDataFrame([("b", 2)], "NAME string, run long"), path)  # other order and case, one missing
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == [(1, "a", [1]), (2, "b", None)]
    for bad, message in (("run int, name string", "run is int, stored as bigint"), ("run long, other string", "columns the table doesn't have: other"),
                         ("run string, other string", "other; run is string")):
        with pytest.raises(ValueError, match=message):
            registry.append(spark.createDataFrame([], bad), path)
    with pytest.raises(ValueError, match="one name"):
        registry.append(spark.createDataFrame([(1, 2)], "run long, x long").toDF("run", "RUN"), path)
    assert spark.read.parquet(path).count() == 2


ONE = '{"component":"tires","classification":"Good","reasoning":"a \\"quoted\\" } brace"}'
FAULTS = [
    (None, "no_answer", 0, None),
    ("", "prose", 0, None),
    ("The tires look worn.", "prose", 0, None),
    (f'{{"assessments":[{ONE},{ONE}]}}', "ok", 2, None),
    (f' \n {{ "assessments" : [ {ONE} ] }} ', "ok", 1, None),
    ('{"assessments":[]}', "empty", 0, None),
    (f'{{"assessments":[{ONE},{{"component":"bra', "truncated", 1, 1),
    (f'{{"assessments":[{ONE},{ONE},', "truncated", 2, 2),
    (f'{{"assessments":[{ONE}', "truncated", 1, 1),
    ('{"assess', "truncated", 0, None),
    (f'{{"assessments":[{ONE},{{"component":nope}}]}}', "bad_json", 1, 1),
    (f'{{"assessments":[{ONE} {ONE}]}}', "bad_json", 0, 0),
    (f"```json\n{{\"assessments\":[{ONE},{ONE}]}}\n```", "fenced", 2, None),
    (f"```\n{{\"assessments\":[{ONE},{{\"comp", "fenced", 1, 1),
    (f"[{ONE}]", "wrong_shape", 0, None),
    ('{"assessments":{"component":"tires"}}', "wrong_shape", 0, None),
    (f'{{"assessments":[{ONE},5,{ONE}]}}', "wrong_shape", 1, 1),
    ('"text"', "wrong_shape", 0, None),
    ('{"assessments":[' + ",".join([ONE] * 3000), "truncated", 3000, 3000),
    ('{"assessments":[{"component":"' + "x" * 200_000, "truncated", 0, 0),
]


def test_faults_name_the_first_broken_entry(spark):
    df = spark.createDataFrame([(k, raw) for k, (raw, *_) in enumerate(FAULTS)], "service_id long, raw string")
    got = {r.service_id: (r.fault, r.whole_entries, r.broken_at) for r in assess.answer_faults(df).collect()}
    want = {k: tuple(x) for k, (_, *x) in enumerate(FAULTS)}
    assert {k: (got[k], want[k], FAULTS[k][0]) for k in got if got[k] != want[k]} == {}
    assert json.loads(FAULTS[3][0])["assessments"][0]["component"] == "tires"
