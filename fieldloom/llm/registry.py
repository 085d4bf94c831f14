"""The text operators' queries and their SQL, by name."""

from __future__ import annotations

import importlib

#: Modules of this package with QUERIES and ORACLE_SQL.
MODULES = (
    "chat_format",
    "line_dedup",
    "language_id",
    "decontaminate",
    "simhash",
    "bpe",
    "html_extract",
    "suffix_dedup",
    "host_rules",
    "substring_dedup",
    "prefix_trie",
    "hard_negatives",
    "piece_bpe",
)


def _modules():
    return [importlib.import_module(f"fieldloom.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLE_SQL.items()}
