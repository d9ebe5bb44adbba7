"""How a module of queries collects them."""

from __future__ import annotations

from .views import oracle


def registry():
    """(queries, sql, decorator): the decorator takes the oracle's SQL, or nothing where SQL can't express the query."""
    found: dict = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f):
            found[f.__name__] = f
            if text:
                sql[f.__name__] = oracle(text)
            return f

        return add

    return found, sql, query
