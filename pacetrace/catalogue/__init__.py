"""Queries over the supplied tables, one or more per operator."""

from __future__ import annotations

import importlib

FAMILIES = ("laps", "grid", "phases", "corners", "inputs", "debrief", "geometry", "streaming")


def load():
    """Import every family once and return the registry."""
    from .registry import QUERIES

    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}_queries")
    return QUERIES
