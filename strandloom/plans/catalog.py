"""All registered queries and their SQL."""

from __future__ import annotations

from strandloom.plans import curation, files, joins, likeness, ranks, scalars, selections
from strandloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "curation", "files", "joins", "likeness", "ranks", "scalars", "selections"]
