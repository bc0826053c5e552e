"""Named queries of the engine and the SQL that other engines can check them with."""

from __future__ import annotations

QUERIES = {}
ORACLE_SQL = {}
FLAGSHIP = "rrf_fuse_ordinal"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
