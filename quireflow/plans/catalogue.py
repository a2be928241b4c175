"""All queries over the reference's operators, with DuckDB SQL of the same meaning."""

from __future__ import annotations

from . import checks, papers, projects, questions, records, rules, services, streams, timeline

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (projects, records, checks, papers, questions, streams, timeline, services, rules):
    QUERIES |= _module.ADD.queries
    ORACLES |= _module.ADD.oracles
