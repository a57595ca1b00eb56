"""Physical plan checks: where the exchange sits, Python only where needed,
pruned scans, one model call per row."""
from pyspark.sql import functions as F

from service_insights.operators import assess, compare, scoring
from service_insights.plans import pipelines, queries
from service_insights.sources import fixtures, registry

from conftest import SF0001

CFG = pipelines.seed_configs()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exchange_below_python_scorer(spark):
    s = fixtures.service(spark, SF0001)
    rows = pipelines.run_config(s, CFG["balanced"], limit=20,
                                scorer=scoring.CannedScorer({}, default='{"assessments":[]}'))
    plan = _plan(rows)
    i_map, i_ex = plan.find("MapInArrow"), plan.find("RoundRobinPartitioning(20)")
    assert i_map >= 0 and i_ex > i_map, plan  # parent printed first: exchange is below
    assert "TakeOrderedAndProject" in plan


def test_rule_scorer_has_no_python(spark):
    for name in ["assessments", "compare_rows", "urgent_findings", "confusion"]:
        plan = _plan(queries.QUERIES[name](spark, SF0001))
        for node in ("MapInPandas", "MapInArrow", "BatchEvalPython", "ArrowEvalPython"):
            assert node not in plan, (name, node)


def test_service_scan_is_pruned(spark):
    plan = _plan(queries.QUERIES["catch_count"](spark, SF0001))
    scan = [line for line in plan.split("\n") if "lineitem" in line][0]
    assert "l_extendedprice" not in scan and "l_linestatus" not in scan


def test_compare_is_one_pass(spark):
    plan = _plan(queries.QUERIES["compare_rows"](spark, SF0001))
    # lineitem read once; one exchange for its aggregation; the compare is row-local
    assert plan.count("FileScan parquet") == 1, plan
    assert plan.count("Exchange hashpartitioning") == 1, plan
    assert "Join" not in plan and "Union" not in plan


def test_lineitem_aggregation_is_hash_based(spark):
    plan = _plan(queries.QUERIES["catch_count"](spark, SF0001))
    assert "SortAggregate" not in plan, plan


def test_scored_once_per_row(spark, tmp_path):
    acc = spark.sparkContext.accumulator(0)
    s = fixtures.service(spark, SF0001)
    n = s.count()
    scorer = scoring.CannedScorer({}, default='{"assessments":[]}', calls=acc)
    out = str(tmp_path / "recs")
    pipelines.recommendations(s, CFG["balanced"], scorer, partitions=4).write.parquet(out)
    spark.read.parquet(out).count()
    assert acc.value == n


def test_row_local_queries_shuffle_only_for_the_fixture(spark):
    """Compare and dedupe of answers on one row add no exchange: the only
    shuffle left is the lineitem de-dup that derives ``service``."""
    for name in ["compare_rows", "dedupe_assessments", "assessments", "contract_violations"]:
        assert _plan(queries.QUERIES[name](spark, SF0001)).count("Exchange hashpartitioning") == 1, name


def test_scorer_is_not_inlined_into_filters(spark):
    """No optimizer rewrite copies the scorer: the optimized plan holds no
    more regex evaluations than the analyzed one."""
    for name in ["assessments", "dedupe_assessments", "compare_rows", "confusion", "score_notes"]:
        qe = queries.QUERIES[name](spark, SF0001)._jdf.queryExecution()
        analyzed, optimized = qe.analyzed().toString(), qe.optimizedPlan().toString()
        assert optimized.count("regexp_extract") <= analyzed.count("regexp_extract"), name
        assert len(optimized) < 100_000, name


def test_full_run_fan_out_starts_no_job(spark):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup())
    assert scoring.full_run_partitions(spark) == 32  # shuffle partitions are fewer here
    spark.conf.set("spark.sql.shuffle.partitions", "80")
    try:
        assert scoring.full_run_partitions(spark) == 80
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup()) == before


def test_keyed_operators_shuffle_their_payload_once(spark):
    """A limit of one row a key below each exchange, and no exchange between the windows and the join."""
    rows = spark.range(1000).selectExpr("id % 10 AS service_id", "'tires' AS component_key", "'Good' AS classification",
                                        "repeat('x', 20) AS reasoning", "cast(id as int) AS pos")
    plan = _plan(assess.dedupe_latest(rows))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Range (") == 1, plan
    assert plan.rfind("WindowGroupLimit") > plan.find("Exchange hashpartitioning"), plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(compare.compare_keyed(rows, rows.withColumn("reasoning", F.lit("y"))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("WindowGroupLimit") == 4 and "FullOuter" in plan, plan
    for name in ["dedupe_stored", "compare_stored"]:
        plan = _plan(queries.QUERIES[name](spark, SF0001))
        assert "SortAggregate" not in plan and "WindowGroupLimit" in plan, name


def test_hot_service_is_no_hot_task(spark):
    """Half the rows on one id: what is left after the map tasks' limit is a row a key and task, over all tasks."""
    rows = spark.range(40_000).selectExpr("if(id % 2 = 0, 0, id) AS service_id", "concat('c', id % 24) AS component_key", "'Good' AS classification",
                                          "cast(id as string) AS reasoning", "id AS pos").repartition(8)
    other = rows.withColumn("classification", F.lit("Urgent"))
    out = compare.compare_keyed(rows, other)
    assert out.count() == 20_000 + 12 and out.where("differs").count() == 20_012
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in compare.compare_keyed(rows, other).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 1.5 * sorted(sizes)[len(sizes) // 2], sizes


def test_insert_only_merge_does_not_move_the_target(spark):
    target = spark.range(200000).selectExpr("id AS vehicle_id", "repeat('x', 50) AS pay")
    batch = spark.range(199990, 200010).selectExpr("id AS vehicle_id", "'new' AS pay")
    for merged in (registry.merge_insert_only(target, batch, ["vehicle_id"]),
                   registry.merge_upsert(target, batch, ["vehicle_id"])):
        rows = {r.vehicle_id: r.pay for r in merged.filter("vehicle_id >= 199990").collect()}
        assert len(rows) == 20 and rows[200005] == "new"
        assert merged.count() == 200010
        plan = _plan(merged)
        assert "SortAggregate" not in plan, plan
    small = registry.merge_upsert(target, batch, ["vehicle_id"])
    assert _plan(small).count("Range (") <= 3  # the target once, the batch twice


def test_urgent_reasons_do_not_shuffle(spark):
    plan = _plan(queries.QUERIES["urgent_findings"](spark, SF0001))
    # no group-by of exploded rows; the joins are broadcast at this size
    assert "collect_list" not in plan, plan
    assert plan.count("Exchange hashpartitioning") == 1, plan
    # the scorer is never inlined into a filter below the projection
    assert not [line for line in plan.split("\n") if "Filter" in line and "regexp" in line], plan
