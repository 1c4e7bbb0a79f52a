"""All queries and their oracle SQL, by key."""

from __future__ import annotations

from sessionloom.checks import evaluation, feature_views, log_and_tables, modelling, preparation

GROUPS = [log_and_tables, feature_views, preparation, evaluation, modelling]


def queries() -> dict:
    return {name: q for group in GROUPS for name, q in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for group in GROUPS for name, sql in group.ORACLE.items()}
