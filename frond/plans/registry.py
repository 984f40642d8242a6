"""All registered queries of the engine's own operators, by name, and the SQL that each agrees with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "fused_index_report"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL, tests hold it against a brute-force version."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


from frond.plans import evaluation, images, index, inference, models, ordered, relational, reports, scalars, series, shapes, sinks, sketches, statistics, streams, tissue, training  # noqa: E402, F401
