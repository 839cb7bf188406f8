"""The store flavours (S4): names, aliases and what sets them apart."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Flavour:
    name: str
    supports_normalization: bool
    on_conflict: str            # "ignore" (unique keys enforced) or "append"
    whole_seconds: bool         # timestamps stored to the second
    missing_table_counts_zero: bool


FLAVOURS = {
    "postgres": Flavour("postgres", True, "ignore", False, False),
    "mysql": Flavour("mysql", True, "ignore", True, False),
    "duckdb": Flavour("duckdb", True, "ignore", False, False),
    "elasticsearch": Flavour("elasticsearch", False, "append", False, True),
}
# The backend aliases accepted by the reference CLI.
ALIASES = {"pg": "postgres", "postgresql": "postgres", "es": "elasticsearch",
           "elastic": "elasticsearch", "duck": "duckdb"}


def get_flavour(name: str) -> Flavour:
    n = ALIASES.get(name.lower(), name.lower())
    if n not in FLAVOURS:
        raise ValueError(f"no store flavour {name!r}; choose one of {', '.join(FLAVOURS)}")
    return FLAVOURS[n]


def list_flavours() -> list[tuple[str, bool]]:
    """(name, supports_normalization) per store flavour."""
    return [(f.name, f.supports_normalization) for f in FLAVOURS.values()]


def resolve_normalize(flavour: Flavour, normalize: bool) -> tuple[bool, str | None]:
    """Normalising into a store without it falls back to a flat load, with a warning."""
    if normalize and not flavour.supports_normalization:
        return False, f"the {flavour.name} flavour keeps no dimensions, so rows are loaded flat"
    return normalize, None
