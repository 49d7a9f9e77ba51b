"""A corpus pipeline of five operators, each stage over all that the stage before it kept.

Quality rules, exact dedup, near dedup, mixing to target weights, packing. No SQL expresses the packing of token ids, so
``ORACLE_SQL`` is None and the tests hold the rows against a brute-force version.

Each stage takes any rows with the columns of documents, and more columns of any names, which stay: null and empty texts
fail the quality rules, as do all under fifty words; a null lang is judged by the base rules alone; a null source is a
source; a null doc_id is an id like any other, and rows that share an id are told apart by their texts. Texts are read
whole, whatever their length. An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trawlspark.llm.divergence import passing
from trawlspark.llm.exact_dedup import drop_exact_duplicates
from trawlspark.llm.mixing import mixed_documents
from trawlspark.llm.near_dedup import one_of_each
from trawlspark.llm.packing import pack
from trawlspark.llm.queries import tokenizer_file
from trawlspark.storage import checkpoint_dir, remove, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are far from every language reference, go."""
    return passing(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id stays."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their targets."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left in windows of tokens."""
    return pack(docs, tokenizer_file(), with_ids=False).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``, each written as Parquet into the shared folder and read again by the next.

    A stage's checkpoints go when its table is written, and its input table when the next one's is: beside the input and
    the result no more than two tables are held at a time. The last stage is returned as it is, to be written by the
    caller, so the table that it reads and its checkpoints stay.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
        docs = spark.read.parquet(before)
    return STAGES[-1][1](spark, docs, sf_dir)
