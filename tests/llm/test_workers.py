"""What the operators leave in an executor's Python workers."""
import weakref

import corpus_pipeline
import public_tokenizers
import pytest

from service_insights.llm import bpe, common, jaccard

PYTHON = ("MapInArrow", "FlatMapGroupsInArrow", "FlatMapCoGroupsInArrow", "MapInPandas", "FlatMapGroupsInPandas", "ArrowEvalPython", "BatchEvalPython")


def steps(node) -> int:
    """Most Python steps that one task of a plan runs at a time: an exchange ends a task."""
    most = 0

    def walk(x) -> int:
        nonlocal most
        if x.nodeName() == "AdaptiveSparkPlan":
            return walk(x.initialPlan())
        own = sum(walk(x.children().apply(k)) for k in range(x.children().size())) + (x.nodeName() in PYTHON)
        most = max(most, own)
        return 0 if "Exchange" in x.nodeName() else own

    walk(node)
    return most


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_a_task_of_jaccard_runs_one_python_step(spark, tmp_path, monkeypatch, threshold):
    rows = [(k, " ".join(f"w{k % 4}x{j}" for j in range(60)) + f" end{k}") for k in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    found = []

    def seen(df):
        found.append(steps(df._jdf.queryExecution().executedPlan()))
        return common.saved(df)

    monkeypatch.setattr(jaccard, "saved", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        out = jaccard.jaccard_components(spark.read.parquet(f"{tmp_path}/docs")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["doc_id"]: r["component_id"] for r in out} == {k: k % 4 for k in range(12)}
    assert max(found) == 1


def test_a_worker_holds_one_large_object():
    coder = weakref.ref(bpe.tokenizer(public_tokenizers.path(corpus_pipeline.TOKENIZER)))
    assert bpe.tokenizer(public_tokenizers.path(corpus_pipeline.TOKENIZER)) is coder()
    other = common.held(("another operator",), dict)
    assert common.held(("another operator",), list) is other
    assert coder() is None
