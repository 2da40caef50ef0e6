"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontamination, jaccard, mixing, outliers, quality, secrets, sharding, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_robust_outliers": outliers.op2_robust_outliers,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_suffix_dedup": substrings.op5_suffix_dedup,
    "op6_toxicity_cnn": toxicity.op6_toxicity_cnn,
    "op7_fm_index_dedup": substrings.op7_fm_index_dedup,
    "op8_ordinal_quality": quality.op8_ordinal_quality,
    "op9_extendible_shards": sharding.op9_extendible_shards,
    "op10_latent_decontamination": decontamination.op10_latent_decontamination,
}

SQL: dict[str, str] = {
    "op3_jaccard_join": jaccard.OP3_SQL,
    "op7_fm_index_dedup": substrings.OP7_SQL,
    "op1_secret_scan": secrets.OP1_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
    "op9_extendible_shards": sharding.OP9_SQL,
}
