"""All queries of the library itself, with their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("texts", "privacy", "conversations", "evaluation", "balance", "retrieval", "ingest", "extras", "construction", "judges")


def queries() -> dict:
    """Name to query function ``(spark, sf_dir) -> DataFrame``."""
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"corpusmill.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    """Name to the SQL twin."""
    found: dict = {}
    for name in MODULES:
        found |= importlib.import_module(f"corpusmill.plans.{name}").ORACLES
    return found


def flagship(spark, sf_dir):
    """Clean, mask, de-duplicate, gate and count by language."""
    return queries()["flagship_curation"](spark, sf_dir)
