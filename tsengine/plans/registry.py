"""Registered queries: one Spark callable per operator (or bundle) and its DuckDB oracle.

``exact`` lists the non-DOUBLE output columns (kept as-is by the SQL normaliser), ``ts`` the
timestamp columns among them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    fn: QueryFn
    sql: str | None = None
    exact: list[str] = field(default_factory=list)
    ts: list[str] = field(default_factory=list)
    all_exact: bool = False


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, exact=(), ts=(), all_exact: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = Entry(fn, sql, list(exact), list(ts), all_exact)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # importing the query modules fills REGISTRY
    from tsengine.plans import queries_eval, queries_features, queries_io, queries_models, queries_more, queries_reports, queries_streams, queries_tables  # noqa: F401
    t04, j04 = REGISTRY.get("t04_enrich_messages_stream"), REGISTRY.get("j04_message_price_context")
    if t04 is not None and j04 is not None and t04.sql is None:  # the stream equals its batch twin
        t04.sql, t04.exact, t04.ts = j04.sql, list(j04.exact), list(j04.ts)
    return REGISTRY
