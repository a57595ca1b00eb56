"""The corpus pipeline against a plain version of its decisions."""
import corpus_pipeline
from service_insights.llm.common import saved

from . import helpers as H

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_clean_documents_and_columns(spark, tmp_path):
    clean = [(k, "\n".join(f"{w} {w}{k} {w}{k * 7} end" for w in ("alpha", "beta", "gamma", "delta", "eps", "zeta"))) for k in range(30)]
    item = "the quick benchmark question asks for exactly twelve words in one row"
    docs = clean + [(100, clean[3][1]), (101, "leak " + item + " tail"), (102, clean[5][1] + " more"), (103, None), (104, ""), (None, "no id at all")]
    rows = [(d, t, "en", "src", len(t or "")) for d, t in docs]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = saved(stage(spark, frame, str(tmp_path)))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    out = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert {d for d, _ in clean} <= ids and not {100, 101} & ids and {103, 104, None} <= ids
    by = {r["doc_id"]: r for r in out}
    assert by[4]["text"] == clean[4][1] and by[4]["n_tokens"] == len(by[4]["ids"])
    assert by[4]["n_chars"] == len(clean[4][1])


def test_stages_on_empty_documents(spark, tmp_path):
    frame = spark.createDataFrame([], COLUMNS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        frame = saved(stage(spark, frame, str(tmp_path)))
    assert frame.collect() == []


def test_run_equals_stages_judged_plainly(spark):
    """At sf0.001 each stage's result is what the plain versions give on its own input."""
    d = "/root/testdata/sf0.001"
    first, second, third, fourth, _ = (f for _, f in corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    a = saved(first(spark, docs, d))
    b = saved(second(spark, a, d))
    texts = {r["doc_id"]: r["text"] for r in a.collect()}
    kept = H.lines(list(texts.items()))
    assert {r["doc_id"]: r["text"] for r in b.collect()} == {k: v for k, v in kept.items() if v or not texts[k]}
    c = saved(third(spark, b, d))
    groups = H.jaccard([(r["doc_id"], r["text"]) for r in b.collect()], 5, 80, 100)
    assert {r["doc_id"] for r in c.collect()} == {k for k, (_, g) in groups.items() if g == k}
    e = saved(fourth(spark, c, d))
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    hit = H.contained([(r["doc_id"], r["text"]) for r in c.collect()], items)
    assert {r["doc_id"] for r in e.collect()} == {k for k, x in hit.items() if not x[1]}
    assert corpus_pipeline.run(spark, d).count() == e.count()
