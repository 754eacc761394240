"""All registered queries of the report analytics, and their SQL."""

from __future__ import annotations

from . import analytics, corpus, tables, texts, workflow

PARTS = (analytics, tables, texts, workflow, corpus)
QUERIES: dict = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
