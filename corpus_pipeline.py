"""Five stages from raw documents to packed training sequences.

Each stage takes all that the one before it kept; what a stage returns is written as Parquet to the folder
that driver and executors share and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import materialize, table
from tidemark.llm.mixing import stage_mixing
from tidemark.llm.near_dedup import stage_near_dedup
from tidemark.llm.packing import stage_packing
from tidemark.llm.pii import stage_pii
from tidemark.llm.quality import stage_quality

STAGES = [
    ("quality", stage_quality),
    ("near_dedup", stage_near_dedup),
    ("pii", stage_pii),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: A learned classifier and a packer have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
