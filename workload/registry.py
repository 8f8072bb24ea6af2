"""Registration of queries with their SQL."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if sql:
                self.oracles[name] = sql
            return fn

        return add
