"""The queries of this subpackage and the SQL that says the same."""

from __future__ import annotations

from importlib import import_module

_OPS = {
    "op1_warc": "warc",
    "op2_simhash": "simhash",
    "op3_secrets": "secrets",
    "op4_exact_dedup": "exact_dedup",
    "op5_quality": "quality",
    "op6_substring_dedup": "substring",
    "op7_sentencepiece": "pieces",
    "op8_decontaminate": "decontaminate",
    "op9_lm_score": "lm",
    "op10_language": "language",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _OPS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in _OPS.items()}
    return {name: sql for name, sql in found.items() if sql}
