"""The queries over the reference tables and their SQL."""

from __future__ import annotations

from spanloom.plans import analysis, cleaning, detectors, training

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _module in (analysis, detectors, cleaning, training):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
