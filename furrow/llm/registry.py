"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import importlib

import corpus_pipeline

MODULES = ("bag_search", "bpe", "chat", "digest_index", "divergence", "fingerprints", "html_extract", "mixing", "mtree",
           "ngram_join", "pii", "suffix_dedup", "toxicity")


def _modules():
    return [importlib.import_module(f"furrow.llm.{m}") for m in MODULES]


def queries() -> dict:
    out = {"pipeline": corpus_pipeline.run}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict:
    out = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    for m in _modules():
        out.update(getattr(m, "ORACLES", {}))
    return out
