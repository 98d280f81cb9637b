"""The registered queries: name to (query, SQL or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("facets", "derivations", "texts", "joins", "quality", "entities", "curation")


def entries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"{__name__}.{m}").QUERIES
    return out
