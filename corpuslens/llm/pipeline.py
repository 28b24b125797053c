"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, source mixing.

Each stage reads the table its predecessor wrote, works on all of it, and writes its own; all but the last return the
columns of their input, whatever they are called. Decisions are carried by a digest of the text (equal texts are
judged alike) or by the document's id, never by a column added to the texts.

Defined results of the stages: a null text has no words, is scored like an empty one and matches nothing; a row with a
null id is no copy of anything; rows of one id are one document, and rows that repeat id and text are one row after the
near-duplicate stage; empty tables give empty tables; columns besides doc_id, text and source are carried along and play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, forest, mixing, toxicity
from corpuslens.llm.sieve import free_name, text_key, without_texts
from corpuslens.plans.lineage import written

#: Ids up to which those to drop are sent to every task (8 bytes each).
SENT_IDS = 1 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones among them, scores below 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    network = toxicity.fit(docs, labels)
    keyed = docs.select(F.coalesce(text_key(F.col("text")), F.lit(b"")).alias("key"), "text")
    bad = written(toxicity.score(keyed, network, id_col="key").where("score >= 0.3").select("key").distinct(), "toxic")
    kept = without_texts(docs, bad)
    return kept.where(F.col("text").isNotNull()) if bad.where(F.col("key") == F.lit(b"")).count() else kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id, once; rows without an id stay."""
    judged = forest.near_duplicates(docs.select("doc_id", "text"), width=5, least=80)
    ids = judged.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_and("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    ids = written(ids.where("NOT stays OR n > 1"), "decided")
    gone, repeated = ids.where("NOT stays OR n > 1"), ids.where("stays AND n > 1")
    gone = F.broadcast(gone) if gone.count() <= SENT_IDS else gone
    mine = free_name("gone", docs.columns)
    kept = docs.join(gone.select(F.col("doc_id").alias(mine)), F.col("doc_id") == F.col(mine), "left_anti")
    if repeated.isEmpty():
        return kept
    key = free_name("key", docs.columns)
    again = docs.join(repeated.select(F.col("doc_id").alias(mine)), F.col("doc_id") == F.col(mine), "left_semi")
    again = again.withColumn(key, F.coalesce(text_key(F.col("text")), F.lit(b""))).dropDuplicates(["doc_id", key])
    return kept.unionByName(again.drop(key))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with any benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: doc_id, source, size, source_size, target, taken (words, repeats counted), copies; documents it does not reach have taken 0."""
    mixed = mixing.mixed_documents(docs)
    return mixed.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "taken", "copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]
#: The network, the shuffled order and the forest's hashes can't be said in SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
