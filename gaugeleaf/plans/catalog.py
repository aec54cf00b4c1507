"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from . import aggregates, answers, books, documents, folds, relational, retrieval, scalars, streams, windows, workbooks  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict[str, Callable]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
