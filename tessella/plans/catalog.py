"""Registry of the library's queries and of their DuckDB counterparts."""

from __future__ import annotations

from tessella.plans import documents, fields, orders, reading

QUERIES = documents.QUERIES | fields.QUERIES | orders.QUERIES | reading.QUERIES
ORACLES = documents.ORACLES | fields.ORACLES | orders.ORACLES | reading.ORACLES
