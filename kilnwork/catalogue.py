"""The registered queries of the generic operators, with their SQL."""

from __future__ import annotations

from kilnwork.plans import content, files, library, lines, parts, relations, vectors
from kilnwork.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "content", "files", "library", "lines", "parts", "relations", "vectors"]
