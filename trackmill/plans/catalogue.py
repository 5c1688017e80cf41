"""Queries over the reference's operators, and SQL to hold them against."""

from __future__ import annotations

from trackmill.operators import aggregates, calibrate, evaluate, identity, maintenance, mot, reciprocal, registry, reports, retrieval, resolve, scans, sequence, spatial, supplements
from trackmill.streaming import state, store, stream

_MODULES = (scans, aggregates, sequence, spatial, identity, evaluate, maintenance, supplements, registry, resolve, reciprocal, calibrate, retrieval, mot, reports, stream, state, store)
QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL: dict[str, str] = {name: text for m in _MODULES for name, text in m.SQL.items()}
