"""From raw documents to packed sequences: the stages of a training-data pipeline, in order.

run() hands the documents of sf_dir to the first stage, writes what a stage returns as Parquet in the shared checkpoint
folder and rereads it as the next one's input. All stages but the last return the columns of documents.

A null text is an empty one throughout (mixing, which takes words, takes none of it), an empty table passes as an empty
one, extra columns stay, repeated rows are copies of one another to the deduplicating stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.exact_dedup import drop_exact
from tessera.llm.jaccard_join import drop_near
from tessera.llm.mixing import mixed_documents
from tessera.llm.packing import pack
from tessera.llm.quality import keep_good
from tessera.llm.registry import ship
from tessera.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores as good."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest id."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return drop_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixed), ("packing", packed)]

#: A trained classifier and a tokenizer can't be stated in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
