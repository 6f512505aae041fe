"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("warc", "class_lm", "suffix_dedup", "toxicity", "mixing", "decontaminate", "language_id", "token_count", "jaccard_join", "exact_dedup")

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in MODULES:
    _x = import_module(f"quire.llm.{_m}")
    QUERIES |= _x.QUERIES
    ORACLE_SQL |= _x.ORACLE_SQL
