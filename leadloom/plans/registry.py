"""The core's queries by name, and their SQL."""

from __future__ import annotations

from leadloom.plans import copies, core, core_sql, more, more_sql, sites, sites_sql


def queries() -> dict:
    return {"p1_found": copies.p1_found} | {f.__name__: f for f in (*core.QUERIES, *sites.QUERIES, *more.QUERIES)}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": copies.P1_SQL} | core_sql.SQL | sites_sql.SQL | more_sql.SQL
