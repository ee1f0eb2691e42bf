"""All queries of the library by name, with the SQL that checks them."""

from __future__ import annotations

from . import content_queries, process_queries, report_queries, rollup_queries, safety_queries, source_queries, more_queries  # noqa: F401  they register themselves
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
