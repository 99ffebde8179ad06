"""Every query of the price engine with its oracle."""

from __future__ import annotations

from importlib import import_module

#: Modules that hold QUERIES and ORACLE_SQL.
MODULES: tuple[str, ...] = (
    "feira.functions.text",
    "feira.functions.values",
    "feira.operators.listing",
    "feira.plans.public",
    "feira.operators.offers",
    "feira.operators.state",
    "feira.operators.warehouse",
    "feira.operators.receipts",
    "feira.operators.baskets",
    "feira.operators.consensus",
    "feira.sources.feeds",
    "feira.sources.channels",
    "feira.operators.lookup",
    "feira.sources.files",
    "feira.operators.layout",
    "feira.operators.classify",
    "feira.operators.discovery",
    "feira.operators.gold",
    "feira.plans.refresh",
    "feira.streaming.prices",
)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(m).QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in import_module(m).ORACLE_SQL.items()}
