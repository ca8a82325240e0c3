"""Registered queries: operators over the bound tables, with equivalent DuckDB SQL."""

from . import cubes, files, geometry, grids, interpolation, light, neighbours, skies  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
