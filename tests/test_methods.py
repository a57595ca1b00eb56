"""Generated methods above HotSpot's limit run interpreted: the session's limit is lowered to it, whatever it was started with."""
import pytest

from service_insights import session
from service_insights.operators import scoring
from service_insights.plans import pipelines, queries
from service_insights.sources import fixtures

from conftest import SF0001

LIMIT = "spark.sql.codegen.hugeMethodLimit"
CFG = pipelines.seed_configs()["all_components"]


@pytest.fixture()
def limit(spark):
    before = spark.conf.get(LIMIT)
    spark.conf.unset(LIMIT)
    yield lambda: int(spark.conf.get(LIMIT))
    spark.conf.set(LIMIT, before)


@pytest.mark.parametrize("name", ["rule_severity", "recommendations", "assessments", "followup_emails", "dedupe_assessments", "confusion", "compare_stored"])
def test_queries_bound_their_methods(spark, limit, name):
    assert limit() > 8000
    queries.QUERIES[name](spark, SF0001)
    assert limit() == 8000


def test_scoring_other_tables_does_too(spark, limit):
    rows = spark.createDataFrame([(1, "Battery: 11.5V resting, age 3 yr.")], "service_id long, service_performed string")
    got = scoring.score(rows, CFG.keys).first()
    assert limit() == 8000 and {a.component: a.classification for a in got.result.assessments}["battery"] == "Urgent"


def test_a_lower_limit_stays(spark, limit):
    spark.conf.set(LIMIT, "2000")
    session.small_methods(spark)
    assert limit() == 2000


def test_rows_do_not_depend_on_it(spark, limit):
    rows = queries.assessments(spark, SF0001)
    bounded = sorted(map(str, rows.collect()))
    spark.conf.set(LIMIT, "65535")
    assert bounded == sorted(map(str, rows.select("*").collect())) and len(bounded) == 12 * fixtures.service(spark, SF0001).count()
