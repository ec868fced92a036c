"""From raw documents to a training mix: five stages, each of which reads what
the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.plans.lineage import cut

STAGES = [
    ("quality", stages.quality_stage),
    ("near_dedup", stages.near_dedup_stage),
    ("decontamination", stages.decontamination_stage),
    ("secrets", stages.secrets_stage),
    ("mixing", stages.mixing_stage),
]

#: Fingerprints (XXH64) and tiling have no SQL; the run is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
