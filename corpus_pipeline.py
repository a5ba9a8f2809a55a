"""Corpus pipeline: language ID, near-duplicates, benchmark decontamination, personal data, mixing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of
``documents``; the last returns each document once per copy that the mix takes, numbered in ``copy``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runtrail.llm.common import shared_dir, table
from runtrail.llm.decontaminate import scan_documents
from runtrail.llm.language import fit, keep_identified
from runtrail.llm.mixing import mixture
from runtrail.llm.pii import redacted
from runtrail.llm.simhash import one_of_each


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; rejected ones go."""
    return keep_identified(docs, fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of least id."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return scan_documents(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by the name of its kind; n_chars follows the text."""
    return redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once per copy."""
    return mixture(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("mix", mix)]

#: Models, fingerprints and automata have no SQL form; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
