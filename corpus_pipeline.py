"""From raw documents to token ids: quality, near copies, benchmark leaks, secrets, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cropgrid.llm import stages
from cropgrid.session import kept_table

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("near_duplicates", stages.near_duplicates),
    ("decontamination", stages.decontamination),
    ("secret_masking", stages.secret_masking),
    ("tokens", stages.tokens),
]

#: The learned rules, the banded alignment and the merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = kept_table(stage(spark, docs, sf_dir), name)
    return docs
