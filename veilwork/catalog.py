"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from .cases import aggregates, joins, plans, selection, sources, text  # noqa: F401  (registration)
from .cases._case import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
