"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crosstally.llm import chat, decontamination, licenses, mixing, quality, quality_rules, sharding, simhash, suffixes, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_sharding": sharding.op2_sharding,
        "op3_licenses": licenses.op3_licenses,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_quality": quality.op5_quality,
        "op6_mixing": mixing.op6_mixing,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_simhash": simhash.op8_simhash,
        "op9_chat": chat.op9_chat,
        "op10_suffix_dedup": suffixes.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_licenses": licenses.OP3_SQL,
        "op4_decontamination": decontamination.OP4_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op7_quality_rules": quality_rules.OP7_SQL,
    }
