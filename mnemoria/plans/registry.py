"""All queries of the library and their SQL."""

from __future__ import annotations

from . import curation, details, recall, research, transfers

QUERIES = recall.QUERIES | curation.QUERIES | details.QUERIES | research.QUERIES | transfers.QUERIES
SQL = recall.SQL | curation.SQL | details.SQL | research.SQL | transfers.SQL
