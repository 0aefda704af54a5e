"""From raw documents to packed training sequences: STAGES in order, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.  All but the last return the
columns of documents.  A null text counts as empty and an empty table stays empty; labels are read from ``sf_dir``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import minhash, packing, quality, substrings, toxicity
from tidemark.sources.workspace import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    return toxicity.score(docs, model, keep=(*COLUMNS,), name="_score").where("_score < 0.5").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the boosted trees."""
    trees = quality.fit(docs, _labels(spark, sf_dir))
    return quality.judge(docs, trees, keep=(*COLUMNS,)).where("kept").select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one with the smallest doc_id.

    Documents without words are no group and stay.  Rows are told apart by a hash of all their columns, so that a null or
    repeated doc_id loses no text; of wholly equal rows one stays.
    """
    rows = docs.select(F.xxhash64(*COLUMNS).alias("_k"), *COLUMNS)
    found = minhash.near_duplicates(rows, key="_k").select("_k", "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_k")
    chosen = found.join(rows.select("_k", "doc_id"), "_k").groupBy("component_id").agg(F.min(order).alias("o")).select("o._k")
    return rows.join(chosen, "_k", "left_semi").dropDuplicates(["_k"]).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words and more that a document with a smaller doc_id has.

    A document of which nothing is left goes; n_chars is counted anew where something was removed.
    """
    left = substrings.without_repeats(docs, keep=("lang", "source", "n_chars"))
    return left.where("n_words = 0 OR n_removed < n_words").withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_filter), ("quality rules", quality_rules), ("MinHash near-dedup", minhash_near_dedup), ("substring dedup", substring_dedup), ("best-fit packing", best_fit_packing)]

#: Classifiers, hashing and tokenizing are not SQL: tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
