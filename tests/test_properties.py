"""Invariants of the operators."""
from pyspark.sql import functions as F

from service_insights.operators import assess, compare, summarize
from service_insights.plans import pipelines
from service_insights.sources import fixtures, generate, registry

from conftest import SF0001

CFG = pipelines.seed_configs()


def _rows(spark, cfg, pos=False):
    return pipelines.run_config(fixtures.service(spark, SF0001), CFG[cfg], None, with_pos=pos)


def test_distribution_sums_to_rows(spark):
    rows = _rows(spark, "all_components")
    total = summarize.distribution(rows).agg(F.sum("n")).first()[0]
    assert total == rows.count()
    piv = summarize.distribution_pivot(rows)
    assert piv.filter("urgent + upcoming + good + other != total").count() == 0


def test_compare_with_itself_has_no_differences(spark):
    a = _rows(spark, "balanced", True)
    cmp = compare.compare_rows(a, a)
    assert cmp.filter("differs").count() == 0
    assert cmp.count() == a.count()


def test_differs_is_symmetric(spark):
    a, b = _rows(spark, "balanced", True), _rows(spark, "strict", True)
    ab = {(r.service_id, r.component_key) for r in compare.compare_rows(a, b).filter("differs").collect()}
    ba = {(r.service_id, r.component_key) for r in compare.compare_rows(b, a).filter("differs").collect()}
    assert ab == ba and ab


def test_compare_null_keys_and_missing_sides(spark):
    schema = "service_id long, component_key string, service_performed string, classification string, reasoning string, pos int"
    a = spark.createDataFrame([(1, "tires", "na", "Urgent", "x", 0), (1, None, "na", "Good", "y", 1),
                               (2, "brakes", "na2", "Good", "z", 0), (2, "brakes", "na2", "Urgent", "z2", 1)], schema)
    b = spark.createDataFrame([(1, None, "nb", "Good", "y", 0), (3, "ac", "nb3", "Upcoming", "w", 0),
                               (1, "tires", "nb", None, None, 0)], schema)
    got = {(r.service_id, r.component_key): r for r in compare.compare_rows(a, b).collect()}
    assert len(got) == 4
    assert got[(1, None)].differs is False  # NULL keys match each other
    assert got[(1, "tires")].differs is True and got[(1, "tires")].service_performed == "na"
    assert got[(2, "brakes")].a_classification == "Urgent"  # later position wins
    assert got[(2, "brakes")].b_classification is None and got[(2, "brakes")].differs is True
    assert got[(3, "ac")].service_performed == "nb3" and got[(3, "ac")].a_classification is None


def test_dedupe_later_wins(spark):
    schema = "service_id long, component_key string, classification string, reasoning string, pos int, seq int"
    rows = spark.createDataFrame([(1, "tires", "Good", "a", 0, 0), (1, "tires", "Urgent", "b", 3, 0),
                                  (1, "tires", "Upcoming", "c", 0, 1), (2, "ac", "Good", "d", 0, 0)], schema)
    got = {(r.service_id, r.component_key): r.classification
           for r in assess.dedupe_latest(rows, seq_col="seq").collect()}
    assert got == {(1, "tires"): "Upcoming", (2, "ac"): "Good"}


def test_upsert_and_seed_merge_idempotent(spark):
    t = fixtures.vehicle(spark, SF0001)
    u = t.filter("vehicle_id % 3 = 0").withColumn("year", F.lit(1999))
    once = registry.merge_upsert(t, u, ["vehicle_id"])
    twice = registry.merge_upsert(once, u, ["vehicle_id"])
    assert sorted(once.collect()) == sorted(twice.collect())
    i1 = registry.merge_insert_only(t, u, ["vehicle_id"])
    assert sorted(registry.merge_insert_only(i1, u, ["vehicle_id"]).collect()) == sorted(i1.collect())
    assert sorted(i1.collect()) == sorted(t.collect())  # matched rows untouched


def test_generator_deterministic_across_partitionings(spark):
    keys = spark.read.parquet(f"{SF0001}/customer.parquet").select("c_custkey")
    a = generate.services(spark, keys.repartition(1), seed=7).collect()
    b = generate.services(spark, keys.repartition(7), seed=7).collect()
    c = generate.services(spark, keys, seed=8).collect()
    assert sorted(a) == sorted(b)
    assert sorted(a) != sorted(c)


def test_generator_shape(spark):
    keys = spark.read.parquet(f"{SF0001}/customer.parquet").select("c_custkey")
    n = keys.count()
    t = generate.generate(spark, keys)
    nv, ns = t["vehicle"].count(), t["service"].count()
    assert 1.5 * n < nv < 2.5 * n and 4 * n < ns < 6 * n + 8
    s = t["service"]
    assert s.select("service_id").distinct().count() == ns
    sizes = s.filter("service_id > 8").select(F.size(F.from_json("ground_truth", "map<string,string>")).alias("k"))
    assert sizes.agg(F.min("k"), F.max("k")).first() == (3, 6)
    # flagged: exactly one Urgent component, or none when nothing is Urgent
    truth = F.from_json("ground_truth", "map<string,string>")
    bad = s.filter("service_id > 8").filter(
        (F.size("flagged_components") > 1) |
        ((F.size("flagged_components") == 1) & (F.element_at(truth, F.col("flagged_components")[0]) != "Urgent")) |
        ((F.size("flagged_components") == 0) & F.array_contains(F.map_values(truth), "Urgent")))
    assert bad.count() == 0
    # generated notes re-score to their stated truth with the balanced rules
    cfg = CFG["all_components"]
    from service_insights.operators import scoring
    scored = scoring.score(pipelines.sample(s, None), cfg.keys)
    assert assess.confusion(scored).filter("truth != predicted").count() == 0


def test_restrict_inside_answer_equals_filter_after_explode(spark):
    s = fixtures.service(spark, SF0001)
    sel = ["battery", "ac", "wipers"]
    cols = ["service_id", "component_key", "classification", "reasoning", "pos"]
    inside = pipelines.run_config(s, CFG["all_components"], None, with_pos=True, components=sel)
    after = assess.restrict_components(
        pipelines.run_config(s, CFG["all_components"], None, with_pos=True), sel)
    restricted = pipelines.run_config(s, pipelines.restrict_config(CFG["all_components"], sel), None)
    assert sorted(inside.select(*cols).collect()) == sorted(after.select(*cols).collect())
    assert sorted(inside.select(*cols[:4]).collect()) == sorted(restricted.select(*cols[:4]).collect())
