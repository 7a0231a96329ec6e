"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from revlens.llm import bpe, licenses, packing, pii, quality_rules, simhash, suffix_dedup, top_k, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_pii": pii.op2_pii,
        "op3_packing": packing.op3_packing,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_simhash": simhash.op7_simhash,
        "op8_bpe": bpe.op8_bpe,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_top_k": top_k.op10_top_k,
    }


def oracle_sql() -> dict[str, str]:
    """The other operators are held against brute force in the tests."""
    return {
        "op4_quality_rules": quality_rules.ORACLE_SQL,
        "op6_url_filter": url_filter.ORACLE_SQL,
        "op10_top_k": top_k.ORACLE_SQL,
    }
