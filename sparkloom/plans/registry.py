"""Registration of queries next to the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """The queries of a module and their SQL; ``views`` are common table expressions an SQL text may start from."""

    def __init__(self, **views: str) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.views = views

    def add(self, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
        """Registers a function under its name; ``views`` go before its SQL."""

        def mark(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                parts = [f"{v} AS ({self.views[v]})" for v in views]
                text = sql.strip()
                if parts and text[:5].upper() == "WITH ":
                    text = f"WITH {', '.join(parts)}, {text[5:]}"
                elif parts:
                    text = f"WITH {', '.join(parts)} {text}"
                self.sql[f.__name__] = text
            return f

        return mark
