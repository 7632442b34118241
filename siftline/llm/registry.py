"""The queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import byte_bpe, exact_dedup, fill_middle, hard_negatives, mixing, packing, pu_quality, quality_rules, secret_scan, sharding, simhash, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_url_filter": url_filter.op3_url_filter,
        "op4_sharding": sharding.op4_sharding,
        "op5_quality_classifier": pu_quality.op5_quality_classifier,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_mixing": mixing.op8_mixing,
        "op9_secret_scan": secret_scan.op9_secret_scan,
        "op10_byte_bpe": byte_bpe.op10_byte_bpe,
        "op11_packing": packing.op11_packing,
        "op12_fill_middle": fill_middle.op12_fill_middle,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
        # parts of operators that SQL can express
        "url_rules": url_filter.url_rules,
        "shard_counts": sharding.shard_counts,
        "mix_targets": mixing.mix_targets,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_quality_rules": quality_rules.ORACLE,
        "op7_exact_dedup": exact_dedup.ORACLE,
        "op13_hard_negatives": hard_negatives.ORACLE,
        "url_rules": url_filter.RULES_ORACLE,
        "shard_counts": sharding.COUNTS_ORACLE,
        "mix_targets": mixing.TARGETS_ORACLE,
    }
