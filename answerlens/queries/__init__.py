"""Registry of runnable queries and their DuckDB statements."""

from __future__ import annotations

from importlib import import_module

MODULES = ["tracking", "relational", "site_audit", "citations", "streams"]


def registry() -> dict:
    """name -> (Spark callable, DuckDB SQL or None)."""
    out: dict = {}
    for name in MODULES:
        for key, value in import_module(f"{__name__}.{name}").QUERIES.items():
            if key in out:
                raise ValueError(f"query {key} is registered twice")
            out[key] = value
    return out
