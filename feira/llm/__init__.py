"""Corpus operators for building training data.

Nothing outside this package imports it. ``queries()`` and ``oracle_sql()`` collect what the modules register.
"""

from __future__ import annotations

from importlib import import_module

#: Modules that hold QUERIES and, where SQL can express the operator, ORACLE_SQL.
MODULES: tuple[str, ...] = (
    "quality", "sharding", "ngram_join", "license_scan", "pii", "substring_dedup", "toxicity", "token_store", "decontaminate", "mixing",
    "whitening", "spelling", "word_table",
)


def queries() -> dict:
    """Name -> callable(spark, sf_dir)."""
    return {k: f for m in MODULES for k, f in import_module(f"feira.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    """Name -> DuckDB SQL, for the operators that SQL can express."""
    return {k: s for m in MODULES for k, s in getattr(import_module(f"feira.llm.{m}"), "ORACLE_SQL", {}).items()}
