"""Prompt composition and catalog operators (small config tables)."""
import json

import pytest
from pyspark.sql import functions as F

from service_insights.constants import (CONTRACT_PREFIX, CONTRACT_SUFFIX, DEFAULT_PROMPT_FOOTER,
                                        DEFAULT_PROMPT_HEADER)
from service_insights.functions.json_text import output_prefix, slug
from service_insights.operators import prompts
from service_insights.plans import pipelines
from service_insights.sources import catalog

CFG = pipelines.seed_configs()


TWO = [{"component_key": "k1", "display_name": "One", "description": "first", "rubric": "r1"},
       {"component_key": "k2", "display_name": "Two", "description": "", "rubric": None}]
HEAD, FOOT = "\n".join(DEFAULT_PROMPT_HEADER), "\n".join(DEFAULT_PROMPT_FOOTER)


def _configs(spark):
    rows = [("two", "two", "Plain prompt.", json.dumps(TWO)), ("bad", "bad json", "Plain prompt.", "{not json"),
            ("null", "null json", "Plain prompt.", None)]
    return spark.createDataFrame(rows, "config_id string, name string, prompt_text string, components string")


def test_composed_prompts(spark):
    got = {r.config_id: r.full_prompt for r in prompts.composed_prompts(_configs(spark)).collect()}
    assert got["two"] == "Plain prompt." + CONTRACT_PREFIX + "k1, k2" + CONTRACT_SUFFIX
    assert got["bad"] == got["null"] == "Plain prompt." + CONTRACT_PREFIX + CONTRACT_SUFFIX


def test_default_prompts(spark):
    got = {r.config_id: r.default_prompt for r in prompts.default_prompts(_configs(spark)).collect()}
    assert got["two"] == HEAD + "\n- One (k1): first\n    Rubric: r1\n- Two (k2)\n" + FOOT
    assert got["bad"] == got["null"] == HEAD + "\n" + FOOT
    assert prompts.prompt_texts(spark, TWO, None) == got["two"] + CONTRACT_PREFIX + "k1, k2" + CONTRACT_SUFFIX


@pytest.mark.parametrize("name,expected", [
    ("My Config!", "my_config"), ("__A--b__", "a_b"), ("!!!", "config"), ("", "config"),
    ("strict v2", "strict_v2")])
def test_slug(spark, name, expected):
    assert spark.range(1).select(slug(F.lit(name))).first()[0] == expected


def test_output_prefix_keeps_configs_apart(spark):
    r = spark.range(1).select(output_prefix(F.lit("A b"), F.lit("0123456789")).alias("a"),
                              output_prefix(F.lit("a-b"), F.lit("abcdefghij")).alias("b")).first()
    assert r.a == "a_b_0123456789" and r.b == "a_b_abcdefghij"


def test_catalog_seed_upsert_delete(spark):
    seed = catalog.seed_components(spark)
    edited = seed.filter("component_key != 'ac'").withColumn(
        "display_name", F.when(F.col("component_key") == "tires", "Tyres").otherwise(F.col("display_name")))
    reseeded = {r.component_key: r.display_name for r in catalog.seed_into(edited, spark).collect()}
    assert len(reseeded) == 12 and reseeded["tires"] == "Tyres"  # edits survive, ac comes back
    upd = spark.createDataFrame([("tires", "Tires", "", "", True, 1), ("horn", "Horn", "", "", True, 13)],
                                catalog.schemas.COMPONENTS)
    up = {r.component_key: r.display_name for r in catalog.upsert_components(edited, upd).collect()}
    assert up["tires"] == "Tires" and up["horn"] == "Horn" and len(up) == 12
    dup = upd.unionByName(upd)
    with pytest.raises(Exception):
        catalog.upsert_components(edited, dup).collect()
    left = catalog.delete_components(seed, ["ac", "nope"], spark)
    assert left.count() == 11
