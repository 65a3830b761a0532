"""All registered queries of the engine's own operators with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepool.sources.tables import VIEWS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "L01_semantic_query"


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` follows the common table expressions of the logical tables."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql:
            views = VIEWS_SQL if not sql.lstrip().upper().startswith("WITH ") else VIEWS_SQL.rstrip() + ","
            ORACLE_SQL[name] = views + (sql.lstrip()[5:] if views.endswith(",") else sql)
        return run

    return register


from tidepool.plans import contexts, extra, graph, maintenance, messages, more, rest, rules, scoring, stats, stores, streams, texts  # noqa: E402, F401
