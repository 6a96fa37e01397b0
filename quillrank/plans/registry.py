"""Queries of the core and their SQL."""

from __future__ import annotations

from quillrank.plans import audits, employment, funnel, labels, nested_tables, records, scoring, search, warehouse

_PAIRS = {**search.QUERIES, **records.QUERIES, **labels.QUERIES, **scoring.QUERIES, **funnel.QUERIES, **audits.QUERIES, **warehouse.QUERIES}

QUERIES = {
    "p1_found": nested_tables.p1_found,
    "child_skills": nested_tables.child_skills,
    "p1_levels": nested_tables.level_totals,
    "p2_found": employment.p2_found,
    "p2_order_periods": employment.customer_order_periods,
    **{name: query for name, (query, _) in _PAIRS.items()},
}

SQL = {
    "child_skills": nested_tables.CHILD_SKILLS_SQL,
    "p1_levels": nested_tables.LEVELS_SQL,
    "p2_found": employment.P2_SQL,
    "p2_order_periods": employment.ORDER_PERIODS_SQL,
    **{name: sql for name, (_, sql) in _PAIRS.items() if sql},
}
