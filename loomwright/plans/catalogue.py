"""The registered queries of the library's own operators."""

from __future__ import annotations

from . import metrics, passthrough, relational, sampling, sequences, sources, streams, structures  # noqa: F401 - they register their queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
