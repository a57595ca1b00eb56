"""The 8 curated services through the rule scorer: hand-worked numbers."""
from pyspark.sql import functions as F

from service_insights.operators import assess, summarize
from service_insights.plans import pipelines
from service_insights.sources.fixtures import demo_services

CFG = pipelines.seed_configs()


def _rows(spark):
    return assess.with_status(pipelines.run_config(demo_services(spark), CFG["balanced"], 10))


def _ids(df, comp, cond):
    return sorted(r.service_id for r in df.filter((F.col("component_key") == comp) & cond)
                  .select("service_id").collect())


def test_tires_golden(spark):
    rows = _rows(spark)
    assert _ids(rows, "tires", F.col("classification") == "Urgent") == [1, 2, 3, 5, 7]
    assert _ids(rows, "tires", F.col("classification") == "Upcoming") == [6]
    assert _ids(rows, "tires", F.col("classification") == "Good") == [4, 8]
    assert _ids(rows, "tires", F.col("technician_flagged")) == [5]
    assert _ids(rows, "tires", F.col("ai_catch")) == [1, 2, 3, 6, 7]


def test_brakes_golden(spark):
    rows = _rows(spark)
    assert _ids(rows, "brakes", F.col("classification") == "Urgent") == [1, 2, 3, 6, 7, 8]
    assert _ids(rows, "brakes", F.col("classification") == "Upcoming") == [5]
    assert _ids(rows, "brakes", F.col("classification") == "Good") == [4]
    assert _ids(rows, "brakes", F.col("technician_flagged")) == []
    assert _ids(rows, "brakes", F.col("ai_catch")) == [1, 2, 3, 5, 6, 7, 8]


def test_status_labels(spark):
    got = {(r.service_id, r.component_key): r.status for r in _rows(spark).collect()}
    assert got[(5, "tires")] == "Yes"
    assert got[(1, "tires")] == "AI catch"
    assert got[(4, "tires")] == "No"


def test_generator_thresholds_agree_with_stated_truth(spark):
    """All 23 stated (service, component) truths equal the balanced rules."""
    from service_insights.operators import scoring
    cfg = CFG["all_components"]
    scored = scoring.score(pipelines.sample(demo_services(spark), None), cfg.keys)
    truth = F.from_json("ground_truth", "map<string,string>")
    pairs = scored.select(F.explode(truth).alias("component", "truth"), "result")
    got = pairs.select("component", "truth", F.filter("result.assessments",
                       lambda a: a["component"] == F.col("component"))[0]["classification"]
                       .alias("pred")).collect()
    assert len(got) == 23
    assert all(r.truth == r.pred for r in got), [r for r in got if r.truth != r.pred]


def test_catch_count_golden(spark):
    got = {r.component_key: r.n_catches for r in summarize.catch_count(_rows(spark)).collect()}
    assert got == {"tires": 5, "brakes": 7}


def test_no_signal_reasoning(spark):
    cfg = CFG["all_components"]
    rows = pipelines.run_config(demo_services(spark), cfg, None)
    r = rows.filter("service_id = 7 AND component_key = 'ac'").first()
    assert r.classification == "Good" and r.reasoning == "No relevant signal in notes."
