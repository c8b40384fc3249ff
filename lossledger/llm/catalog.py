"""Registered queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lossledger.llm import op07_blob_ledger as op07, op08_stratified as op08, op09_contextual as op09, op11_merkle_versions as op11, op13_cover_negatives as op13
from lossledger.llm.op01_isolation import op1_isolation_rules
from lossledger.llm.op02_compression import op2_compression_quality
from lossledger.llm.op03_pfair import op3_pfair_mix
from lossledger.llm.op04_attention import op4_attention_scores
from lossledger.llm.op05_qgram import op5_qgram_decontamination
from lossledger.llm.op06_template import op6_template_extraction
from lossledger.llm.op07_blob_ledger import op7_blob_ledger
from lossledger.llm.op08_stratified import op8_stratified_shards
from lossledger.llm.op09_contextual import op9_contextual_pii
from lossledger.llm.op10_simhash_anchor import op10_simhash_anchor
from lossledger.llm.op11_merkle_versions import op11_merkle_versions
from lossledger.llm.op12_binary_packing import op12_binary_packing
from lossledger.llm.op13_cover_negatives import op13_cover_negatives


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_isolation_rules,
        op2_compression_quality,
        op3_pfair_mix,
        op4_attention_scores,
        op5_qgram_decontamination,
        op6_template_extraction,
        op7_blob_ledger,
        op8_stratified_shards,
        op9_contextual_pii,
        op10_simhash_anchor,
        op11_merkle_versions,
        op12_binary_packing,
        op13_cover_negatives,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op7_blob_ledger": op07.SQL, "op8_stratified_shards": op08.SQL, "op9_contextual_pii": op09.SQL, "op13_cover_negatives": op13.SQL, "op11_merkle_versions": op11.SQL}
