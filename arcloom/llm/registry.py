"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name -> module.
MODULES = {
    "op1_decontaminate": "decontaminate",
    "op2_near_dedup": "near_dedup",
    "op3_url_filter": "url_filter",
    "op4_chat_format": "chat_format",
    "op5_media": "media",
    "op6_bpe": "bpe",
    "op7_licenses": "licenses",
    "op8_substring_dedup": "substring_dedup",
    "op9_secrets": "secrets",
    "op10_toxicity": "toxicity",
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in MODULES.items() if (sql := getattr(import_module(f".{module}", __package__), "SQL", {}).get(name))}
