"""The training-data pipeline: each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lossledger.llm import op02_compression, op03_pfair, op05_qgram, op08_stratified, op10_simhash_anchor
from lossledger.llm.common import shared_folder

STAGES = [
    ("quality_classifier", op02_compression.stage),
    ("simhash_near_dedup", op10_simhash_anchor.stage),
    ("benchmark_decontamination", op05_qgram.stage),
    ("source_mixing", op03_pfair.stage),
    ("sharding", op08_stratified.stage),
]

#: Compression scores and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; returns the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
