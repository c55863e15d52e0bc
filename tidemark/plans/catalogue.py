"""Registry of the archive engine's queries."""

from __future__ import annotations

from tidemark.plans import files, finding, storage  # noqa: F401  (they register their queries)
from tidemark.plans.views import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
