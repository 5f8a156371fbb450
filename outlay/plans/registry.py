"""All named queries of the library and their SQL twins."""

from __future__ import annotations

from outlay.plans import hooks, insight, operate, resolve, spend, stores
from outlay.plans.book import Query

BOOKS = (spend.book, insight.book, resolve.book, operate.book, stores.book, hooks.book)


def queries() -> dict[str, Query]:
    return {name: query for book in BOOKS for name, query in book.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for book in BOOKS for name, sql in book.sql.items()}
