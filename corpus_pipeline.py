"""From documents to packed sequences: quality, near-duplicates, benchmark leaks, identifiers, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import stages
from quern.llm.frames import table
from quern.session import settle

#: (name, function of (spark, docs, sf_dir)); each one's output is written as Parquet and read as the next one's docs.
STAGES = [
    ("quality_classifier", stages.accept_quality),
    ("simhash_near_dedup", stages.drop_near_duplicates),
    ("benchmark_decontamination", stages.drop_leaks),
    ("pii_masking", stages.mask_identifiers),
    ("best_fit_packing", stages.pack),
]

#: SQL can't express the trained classifier, SimHash or banded alignment; tests/llm/test_pipeline.py checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
