"""The registered queries of the core, and the SQL that states the same where SQL can."""

from __future__ import annotations

from sparkloom import queries_graph, queries_more, queries_records, queries_records2, queries_retrieval, queries_telemetry, queries_text

MODULES = (queries_records, queries_telemetry, queries_retrieval, queries_records2, queries_text, queries_graph, queries_more)
QUERIES: dict = {}
ORACLE: dict = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLE |= _m.ORACLE
