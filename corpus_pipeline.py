"""Corpus pipeline: five stages over ``documents``, each one operator of ``service_insights.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's input. All but the last return the
columns of documents. A null id is a document of its own in every stage; rows
that share an id are judged by their own text, but for the Jaccard stage, where
an id stays or goes as one. Empty tables pass through.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from service_insights.llm import bpe, decontaminate, jaccard, line_dedup, toxicity
from service_insights.llm.common import documents, free_name, saved

TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half stay, unchanged."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free_name(docs, "score")
    return toxicity.score(docs, model).where(F.col(name) < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of three-line windows go; a document that loses all its lines goes too. n_chars follows the text."""
    kept, removed = free_name(docs, "kept_text"), free_name(docs, "n_removed")
    out = line_dedup.dedup_lines(docs).where((F.col(removed) == 0) | (F.col(kept) != ""))
    text = F.when(F.col(removed) == 0, F.col("text")).otherwise(F.col(kept))
    new = {"text": text.alias("text"), "n_chars": F.when(F.col(removed) == 0, F.col("n_chars")).otherwise(F.char_length(kept).cast("long")).alias("n_chars")}
    return out.select(*[new.get(c, F.col(c)) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a five-word Jaccard similarity of 0.8 and more, the document of the smallest id stays."""
    groups = jaccard.jaccard_components(docs, shingle=5, num=80, den=100)
    copies = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("n_hit > 0").select(F.col("doc_id").alias("_bad_id"), F.col("tag").alias("_bad_tag")).distinct()
    match = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_bad_tag"])
    return docs.join(bad, match, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts, and the digest of their decoded form."""
    ids, decoded = free_name(docs, "ids"), free_name(docs, "decoded")
    out = bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER))
    return out.select(*docs.columns, F.size(ids).cast("long").alias(free_name(docs, "n_tokens")), ids, F.sha2(F.col(decoded).cast("binary"), 256).alias(free_name(docs, "decoded_sha256")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("bpe", encode),
]

#: The scores of the first stage can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
