"""Row-local answer operators agree with the keyed (shuffle) operators."""
import random

from pyspark.sql import functions as F

from service_insights.operators import answers, assess, compare

ENTRY = "array<struct<component:string,classification:string,reasoning:string>>"
KEYS = ["tires", "brakes", "ac", None]
CLS = ["Urgent", "Upcoming", "Good", None]


def _answer(rng):
    if rng.random() < 0.1:
        return None
    return [(rng.choice(KEYS), rng.choice(CLS), rng.choice(["r1", "r2", None]))
            for _ in range(rng.randint(0, 6))]


def _frame(spark, seed, n=60):
    rng = random.Random(seed)
    rows = [(i, f"notes {i}", _answer(rng), _answer(rng)) for i in range(n)]
    return spark.createDataFrame(rows, f"service_id long, service_performed string, a {ENTRY}, b {ENTRY}")


def _exploded(df, col):
    return assess.explode_rows(df, ["service_id", "service_performed"], F.col(col), val="x", pos="pos") \
        .select("service_id", "service_performed", F.col("x.component").alias("component_key"),
                F.col("x.classification").alias("classification"),
                F.col("x.reasoning").alias("reasoning"), "pos")


def _key(r):
    return tuple((v is None, v) for v in r)


def test_compare_answers_equals_keyed_compare(spark):
    for seed in range(3):
        df = _frame(spark, seed)
        cols = ["service_id", "component_key", "a_classification", "a_reasoning",
                "b_classification", "b_reasoning", "differs"]
        local = answers.compare_answers(df, "a", "b", keep=["service_id"]).select(*cols).collect()
        keyed = compare.compare_rows(_exploded(df, "a"), _exploded(df, "b")).select(*cols).collect()
        assert sorted(map(tuple, local), key=_key) == sorted(map(tuple, keyed), key=_key)


def test_dedupe_runs_equals_keyed_dedupe(spark):
    for seed in range(3):
        df = _frame(spark, 10 + seed)
        local = answers.dedupe_runs(df, ["a", "b"], keep=["service_id"]).collect()
        rows = _exploded(df, "a").withColumn("seq", F.lit(0)).unionByName(
            _exploded(df, "b").withColumn("seq", F.lit(1)))
        keyed = assess.dedupe_latest(rows, seq_col="seq").collect()
        assert sorted(map(tuple, local), key=_key) == sorted(map(tuple, keyed), key=_key)


def test_explode_rows_keeps_null_elements_drops_empty(spark):
    df = spark.createDataFrame([(1, ["x", None]), (2, []), (3, None)], "id int, v array<string>")
    got = sorted(assess.explode_rows(df, ["id"], F.col("v"), val="e").collect(), key=lambda r: (r.id, r.e is None))
    assert [(r.id, r.e) for r in got] == [(1, "x"), (1, None)]


def test_urgent_reasons_on_row_equals_grouped(spark):
    from service_insights.operators import outreach
    for seed in range(3):
        df = _frame(spark, seed).withColumn("vehicle_id", F.col("service_id") % 7)
        recs = assess.explode_rows(df, ["service_id", "vehicle_id"], F.col("a"), val="x").select(
            "service_id", "vehicle_id", F.col("x.component").alias("component_key"),
            F.col("x.classification").alias("classification"), F.col("x.reasoning").alias("reasoning"))
        want = sorted(tuple(r) for r in outreach.urgent_reasons(recs).collect())
        got = sorted(tuple(r) for r in outreach.urgent_reasons_on_row(df, answer="a").collect())
        assert got == want and want
