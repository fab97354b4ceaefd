"""A small registry: a query function, its name and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add


def rounded(*names: str, digits: int = 9) -> dict[str, Column]:
    """Columns rounded so that the order of summation doesn't show."""
    return {n: F.round(F.col(n), digits) for n in names}
