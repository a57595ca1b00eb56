"""op5's shuffles: no text moves but of ends of pairs, and signatures move many to a row."""
import numpy as np
import pyarrow as pa
import pytest

from service_insights.llm import bitmap, common, jaccard

from . import helpers as H
from .test_text_ops import invented


def unsifted(node, above=()) -> list[str]:
    """Exchanges that carry a text, without a broadcast semi join below them."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return unsifted(node.initialPlan())
    kids = [node.children().apply(k) for k in range(node.children().size())]
    out = [x for kid in kids for x in unsifted(kid)]
    names = [node.output().apply(k).name() for k in range(node.output().size())]
    if node.nodeName() == "Exchange" and any(x.startswith("text") for x in names) and "BroadcastHashJoin" not in node.toString():
        out.append(node.toString())
    return out


def test_only_texts_of_pairs_are_shuffled(spark, tmp_path, monkeypatch):
    rows = invented(4)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    found = []

    def seen(df):
        found.extend(unsifted(df._jdf.queryExecution().executedPlan()))
        return common.saved(df)

    monkeypatch.setattr(jaccard, "saved", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = jaccard.jaccard_components(spark.read.parquet(f"{tmp_path}/docs")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == H.jaccard(rows, 4, 85, 100)
    assert found == []


def test_a_full_bitmap_changes_no_component(spark, monkeypatch):
    """Every text passes: what no pair names stays without links."""
    monkeypatch.setattr(jaccard, "LOG_BITS", 7)
    rows = invented(6)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(H.frame(spark, rows)).collect()}
    assert got == H.jaccard(rows, 4, 85, 100)


@pytest.mark.parametrize("log_bits", [7, 12, 25])
def test_kept_loses_no_row(spark, log_bits):
    df = spark.range(-500, 2000).selectExpr("id as node", "cast(id as string) as text")
    of = spark.range(-100, 400, 7).selectExpr("id as node")
    got = {r["node"] for r in bitmap.kept(df, of.union(of), "node", log_bits).collect()}
    assert got >= set(range(-100, 400, 7))
    assert log_bits < 25 or len(got) < 80
    assert bitmap.kept(df, of.where("node > 1000"), "node", log_bits).count() == 0


def test_slabs_are_signed_many_at_a_time(monkeypatch):
    texts = [" ".join(f"w{k}x{j}" for j in range(k % 9 + 1)) for k in range(9000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(9000)), pa.array(texts)], names=["id", "text"])]  # three slabs

    def signed():
        parts = list(jaccard.signed_slabs(iter(batches), 4, 85, 100))
        return len(parts), {(int(i), int(s)) for rows, ids, sigs in parts for i, s in zip(ids[rows], sigs)}

    together = signed()
    monkeypatch.setattr(jaccard, "SIGNATURES", 1)
    apart = signed()
    assert (together[0], apart[0]) == (1, 3) and together[1] == apart[1]
    assert len({i for i, _ in together[1]}) == 9000
    assert list(jaccard.signed_slabs(iter([]), 4, 85, 100)) == []
    assert np.iinfo(np.int32).max > jaccard.SIGNATURES
