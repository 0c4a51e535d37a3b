"""Every registered query of the component-evolution engine, with the SQL that gives the same rows."""

from __future__ import annotations

from . import analytics, benchmarks, content, contracts, relational, reporting, state, upkeep

QUERIES: dict = {**relational.QUERIES, **analytics.QUERIES, **state.QUERIES, **reporting.QUERIES, **upkeep.QUERIES, **benchmarks.QUERIES, **contracts.QUERIES, **content.QUERIES}
SQL: dict[str, str] = {**relational.SQL, **analytics.SQL, **state.SQL, **reporting.SQL, **upkeep.SQL, **benchmarks.SQL, **contracts.SQL, **content.SQL}
