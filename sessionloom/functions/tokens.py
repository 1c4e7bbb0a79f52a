"""Expressions over raw log text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sessionloom.schemas import DEFAULT_NULL_TOKENS, LOG_FIELDS, NULL_TOKENS

# A line whose label columns were glued into the last field has this many fields.
GLUED_FIELDS = len(LOG_FIELDS) - 2


def repair_labels(fields: Column) -> Column:
    """Unglue `tunnel_parents`, `label` and `detailed-label` where they share the last field.

    Only a line of exactly 21 fields whose last field holds three blank-separated words is
    changed; every other line passes through as it is.
    """
    words = F.split(F.regexp_replace(F.get(fields, GLUED_FIELDS - 1), r"^\s+|\s+$", ""), r"\s+")
    head = F.slice(fields, 1, GLUED_FIELDS - 1)
    glued = (F.size(fields) == GLUED_FIELDS) & (F.size(words) == 3)
    return F.when(glued, F.concat(head, words)).otherwise(fields)


def null_token(col: Column, tokens: Iterable[str] | None = None) -> Column:
    """Null where the text is one of the log's or the reader's missing-value tokens."""
    missing = list(tokens) if tokens is not None else NULL_TOKENS + DEFAULT_NULL_TOKENS
    return F.when(~col.isin(missing), col)


def flag_token(col: Column) -> Column:
    """`T`/`F` (and the spelled-out forms a CSV export holds) as a boolean."""
    return F.when(F.upper(col).isin("T", "TRUE"), True).when(F.upper(col).isin("F", "FALSE"), False)
