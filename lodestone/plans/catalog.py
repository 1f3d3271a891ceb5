"""Every registered query over the driver tables, with SQL that states the same result."""

from __future__ import annotations

from . import aggregates, extended, relational, spectral, workflows  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
