"""Every registered query and its oracle SQL."""

from __future__ import annotations

from tidemark.plans import console, details, fleet, formats, lookups, paging, reports, rollups, scheduling, scoring, telemetry, transcripts, writes
from tidemark.plans.register import Query

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (telemetry, scheduling, transcripts, paging, fleet, scoring, writes, formats, lookups, rollups, reports, console, details):
    QUERIES |= _part.registry.queries
    ORACLE_SQL |= _part.registry.oracle
FLAGSHIP = "alert_windowed_counts"
