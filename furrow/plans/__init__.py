"""Registered queries (one per operator of the inventory) and their oracles.

Each pack module exposes ``QUERIES`` (key -> callable(spark, sf_dir) ->
DataFrame) and ``ORACLES`` (key -> DuckDB SQL over the provided tables).
"""

from __future__ import annotations

import importlib

PACKS = (
    "normalize_pack",
    "generate_pack",
    "sink_pack",
    "quality_pack",
    "analytics_pack",
    "star_pack",
    "search_pack",
    "stream_pack",
    "file_pack",
    "sql_pack",
)


def _modules():
    return [importlib.import_module(f"furrow.plans.{p}") for p in PACKS]


def all_queries() -> dict:
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def all_oracles() -> dict:
    out = {}
    for m in _modules():
        out.update(getattr(m, "ORACLES", {}))
    return out
