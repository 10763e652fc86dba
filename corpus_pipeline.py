"""The corpus pipeline: five operators of ``runledger.llm``, one after the other over ``documents``.

Every stage takes what its predecessor kept, written and read again. Quality rules drop the texts they
reject (null and empty ones too); of each group of near copies the row with the smallest doc_id stays; personal
data is replaced in the texts; sources are mixed to their target weights, whole documents as often as they are
taken; the result is packed into sequences. Rows without a doc_id are judged like others, repeated rows are
copies, further columns pass through all stages but the last, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runledger.llm.jaccard import one_of_each
from runledger.llm.mixing import mixed_documents
from runledger.llm.packing import packed
from runledger.llm.pii import redact_pii
from runledger.llm.quality import kept_rows
from runledger.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies: sets of five-word shingles with a similarity of 0.8 or more."""
    return one_of_each(docs, size=5, percent=80, counted=0.3)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: None: suffix arrays, prefix joins and tokenizers are beyond SQL. Tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
