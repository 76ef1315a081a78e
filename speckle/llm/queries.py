"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("packing", "token_counts", "mixing", "exact_dedup", "quality", "token_files", "ann", "pii", "jaccard", "substring_dedup", "quality_rules", "alignment", "filter_audit")


def _modules():
    return [importlib.import_module(f"speckle.llm.{m}") for m in MODULES]


def queries() -> dict:
    import corpus_pipeline

    return {k: f for m in _modules() for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}
