"""Registered queries of the evaluation engine and the SQL they are checked against."""

from __future__ import annotations

from . import detection, flows, tables

FLAGSHIP = "flagship_validation_threshold_test_metrics"
QUERIES: dict = tables.QUERIES | detection.QUERIES | flows.QUERIES
ORACLE_SQL: dict = tables.ORACLE_SQL | detection.ORACLE_SQL | flows.ORACLE_SQL
