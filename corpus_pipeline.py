"""The corpus pipeline: five stages over `documents`, each reading what the one before it wrote.

Each stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the
columns of documents: language ID drops what no language explains, the Jaccard
join leaves one document of each class of near copies, decontamination drops
documents that quote the benchmark, mixing repeats or leaves out documents to
meet the sources' targets, and sharding adds shard, slot and size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import decontaminate, jaccard_join, language_id, mixing, sharding
from ledgerlens.llm.common import written

STAGES = [
    ("language ID", language_id.stage),
    ("n-gram Jaccard join", jaccard_join.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("mixing sources to target weights", mixing.stage),
    ("sharding", sharding.stage),
]

#: Chosen paths and Newton's rounds can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages' result for a folder's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
