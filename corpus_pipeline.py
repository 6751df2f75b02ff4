"""The corpus pipeline: stages over documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newspulse.llm import stages
from newspulse.session import settle

STAGES = [
    ("quality_classifier", stages.keep_quality),
    ("exact_dedup", stages.drop_copies),
    ("minhash_near_dedup", stages.drop_near_copies),
    ("benchmark_decontamination", stages.drop_leaks),
    ("source_mixing", stages.mix_sources),
]

#: No SQL: a trained classifier and a latent semantic search are among the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
