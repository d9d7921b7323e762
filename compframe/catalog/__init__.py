"""Registered queries and their check SQL."""

from __future__ import annotations

import importlib

FAMILIES = ["valuation", "browsing", "market", "appraisal", "extraction", "duplicates", "words", "streams", "files"]


def load():
    """(queries, check SQL) of all families."""
    from compframe.catalog.registry import CHECKS, QUERIES
    for family in FAMILIES:
        importlib.import_module(f"compframe.catalog.{family}")
    return QUERIES, CHECKS
