"""The registered queries of the engine's operators, by family, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from importlib import import_module

from .base import ORACLES, QUERIES

FAMILIES = ("scalars", "aggregations", "readers", "encoders", "quality", "evaluation", "modelling", "language", "workflows")

for _family in FAMILIES:
    import_module(f"{__name__}.{_family}")

__all__ = ["ORACLES", "QUERIES"]
