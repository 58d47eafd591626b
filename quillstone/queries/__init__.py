"""Named queries over the tables, each with the SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from . import decisions, evaluation, pipeline, relational, rendering, similarity, streaming, texts
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "decisions", "evaluation", "pipeline", "relational", "rendering", "similarity", "streaming", "texts"]
