"""Cleaning an answer: as plain Python does it, each step once, whatever the blanks."""
import random
import re

from pyspark.sql import functions as F

from service_insights.functions import json_text
from service_insights.operators import scoring

BLANK = " \t\n\x0b\f\r"


def plain(text):
    t = (text or "").strip(BLANK)
    if not t.startswith("```"):
        return t
    t = re.sub(r"\A[^\n]*\n", "", t) if "\n" in t else t[3:]
    r = t.rstrip(BLANK)
    return (r[:-3] if r.endswith("```") else r).strip(BLANK)


def test_cleaned_as_plain_python(spark):
    deal = random.Random(3)
    parts = ["```", "`", "json", "{", "}", "[]", '"a b"', "\n", " ", "\t", "\x0b", "\f", "\r", " ", "x\n", "{\"a\": 1}"]
    texts = [None, "", "```", "``````", "```\n```", "{}", "{", "}", " {} ", "{\n}\n", "```json\n{}\n```", "```{}```", "a" + " " * 20000 + "b", " " * 20000]
    texts += ["".join(deal.choice(parts) for _ in range(deal.randrange(1, 9))) for _ in range(4000)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.c for r in df.select("k", json_text.strip_fence(F.col("t")).alias("c")).collect()}
    assert [got[k] for k in range(len(texts))] == [plain(t) for t in texts]


def test_each_step_is_written_once(spark):
    """``from_json`` evaluates its input as written: the text is never searched twice for the same thing."""
    df = spark.createDataFrame([('{"assessments": []}',)], "raw string")
    plan = scoring.parsed(df, clean=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 7, plan
