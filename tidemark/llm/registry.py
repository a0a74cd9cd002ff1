"""Queries of the training-data operators and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

import importlib

#: Query name: module that holds query(spark, sf_dir), and ORACLE_SQL where there is one.
MODULES = {
    "op1_quality_rules": "quality_rules",
    "op2_decontamination": "decontamination",
    "op3_near_dedup": "near_dedup",
    "op4_mixing": "mixing",
    "op5_line_dedup": "line_dedup",
    "op6_lm_scoring": "lm_scoring",
    "op7_pii": "pii",
    "op8_chat_format": "chat_format",
    "op9_language_id": "language_id",
    "op10_substring_dedup": "substring_dedup",
}


def queries() -> dict:
    return {name: importlib.import_module(f"tidemark.llm.{m}").query for name, m in MODULES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(importlib.import_module(f"tidemark.llm.{m}"), "ORACLE_SQL", None) for name, m in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
