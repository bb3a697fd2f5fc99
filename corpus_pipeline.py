"""From raw documents to token files: quality rules, near-dedup, decontamination, mixing, token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomscan.llm.common import materialize, table
from loomscan.llm.decontaminate import drop_contaminated
from loomscan.llm.mixing import repeat_mixed
from loomscan.llm.neardup import keep_one
from loomscan.llm.quality import keep_good
from loomscan.llm.tokens import token_stream


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word shingle similarities of 0.8 or more."""
    return keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, sorted by finish time over all files."""
    return repeat_mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the mix's order, that of the stored documents, read back: one row per document of it."""
    return token_stream(docs, stored=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("token_output", token_output)]

#: SQL can't express the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
