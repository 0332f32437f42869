"""Registered queries (``QUERIES``) and their SQL for DuckDB (``ORACLES``), family by family."""

from __future__ import annotations

from . import core, documents, events, formulas, grading, guards, layout, pages, paper, parsing, relational, roster, views

FAMILIES = [core, grading, roster, guards, paper, parsing, layout, pages, formulas, documents, events, relational, views]
QUERIES = {k: v for m in FAMILIES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in FAMILIES for k, v in m.ORACLES.items()}
