"""All registered queries, with the DuckDB text of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from emberline.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


def _prepared(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def catalogue() -> dict[str, tuple[Query, str | None]]:
    from emberline.plans import queries_files, queries_model, queries_profile, queries_rows, queries_text

    found: dict[str, tuple[Query, str | None]] = {}
    for module in (queries_files, queries_rows, queries_profile, queries_text, queries_model):
        for name, (query, sql) in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} registered twice")
            found[name] = (_prepared(query), sql)
    return found
