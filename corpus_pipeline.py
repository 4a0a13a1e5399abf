"""The corpus pipeline: quality, near duplicates, benchmarks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as
Parquet in the shared folder and reads it again for the next stage.

In all stages a row is a document, also where rows share a doc_id or have none; further
columns of docs stay, whatever their names; an empty table gives an empty one; texts are used
whole, however long. What a stage does with nulls, blank texts, ties and repeated rows is said at the stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, mixing, ngram_join, quality, sharding
from graphloom.llm.common import fresh, shared_folder, table
from graphloom.llm.queries import MIX_WEIGHTS, mix_levels


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; null, empty and blank texts go, equal rows are judged alike."""
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id.

    A null doc_id comes after all others; of repeated rows any one stays. Texts without a word are groups of their own.
    """
    return ngram_join.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items; each row is judged by its own text, null and blank ones stay."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mixture selects, once each: 90 % of the tokens, one epoch.

    A document of which the mixture takes a part, the last one of a leaf, is kept whole, so that a leaf may exceed its budget
    by less than one document. Texts without a word are not selected, unless a row with their doc_id is: rows that
    share a doc_id, or have none, stay or go together. Ties in the seeded order are broken by doc_id.
    """
    chosen_id = fresh(docs, "chosen_id")
    chosen = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, per_mille=900, max_epochs=1)
    chosen = chosen.select(F.col("doc_id").alias(chosen_id)).distinct()
    return docs.join(chosen.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(F.col(chosen_id)), "left_semi")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their slot and shard, which replace columns of these names; equal doc_ids, null among them, share a shard."""
    return sharding.place(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each),
    ("decontamination", no_benchmark),
    ("mixture", mixed),
    ("sharding", sharded),
]

#: EM, the scorer and the permutation-filled table can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the table documents."""
    out = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
    return docs
