"""Registered queries over the driver tables and their SQL equivalents."""

from __future__ import annotations

from . import analysis, files, measures, turns

QUERIES = measures.QUERIES | turns.QUERIES | analysis.QUERIES | files.QUERIES
SQL = measures.SQL | turns.SQL | analysis.SQL | files.SQL
