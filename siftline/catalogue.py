"""Every query of the library by name, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.plans import connectors, content, relational, retrieval, streams, upkeep

FLAGSHIP = "hybrid_search"
_PARTS = (retrieval.query, relational.query, content.query, streams.query, upkeep.query, connectors.query)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.sql.items()}
