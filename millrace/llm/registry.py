"""Queries of this subpackage and the SQL that states the same result, where SQL can."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op4_sentence_rule_licences": "licences",
    "op6_layout_text": "render",
    "op3_warc_round_trip": "warc",
    "op7_line_crf_quality": "line_crf",
    "op2_line_frequency": "line_rules",
    "op5_mix_to_weights": "mixing",
    "op10_contained_benchmark_items": "decontam",
    "op1_bootstrapped_pii": "pii",
    "op8_minhash_near_dedup": "near_dedup",
    "op9_run_length_repeats": "repeats",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
