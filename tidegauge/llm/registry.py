"""Queries and SQL of the operators, for the driver's entry file."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("op1_quality", "op2_decontamination", "op3_bpe", "op4_language", "op5_substrings", "op6_embeddings", "op7_simhash", "op8_html", "op9_sharding", "op10_token_counts", "op11_mixing", "op12_phrases", "op13_alignment")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"tidegauge.llm.{name}").queries()
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= getattr(import_module(f"tidegauge.llm.{name}"), "ORACLE_SQL", {})
    return found
