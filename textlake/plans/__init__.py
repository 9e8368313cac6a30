"""Registered queries, one module per family."""

from __future__ import annotations

import importlib

FAMILIES = ("querylog", "texts", "corpus", "search", "ops", "evaluation", "streams")


def load() -> None:
    """Import every family, which registers its queries."""
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
