"""A corpus pipeline over ``documents``: toxicity, near duplicates, repeated lines, personal data, packing.

Each stage works on all that the one before kept, which is written as Parquet and read again in between. All but the last return
the columns of ``documents``; the last returns the pieces of packed sequences.

Edge cases, in every stage: a null text counts as empty and stays null in the documents that are kept; rows of one id and text are rows of their own, of which near
duplicates keep one and the others all; null ids stay; other columns, whatever their names, are passed on; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm.common import shared_dir, table
from spanforge.llm.jaccard_join import one_of_each
from spanforge.llm.line_dedup import without_repeated_units
from spanforge.llm.packing import pack_documents
from spanforge.llm.pii import redact_documents
from spanforge.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return one_of_each(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines, and passages of 50 words or more, that an earlier document holds go; the documents stay."""
    return without_repeated_units(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is written as its kind; the documents stay."""
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_lines", repeated_lines),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL can express neither the classifier nor the tagger nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
