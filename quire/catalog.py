"""All queries of the library with their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.operators import arrow, blocks, census, folds, gates, joins, layout_queries, prose_queries, reports, runs, text, windows
from quire.oracles import layout as layout_oracles
from quire.oracles import prose as prose_oracles
from quire.plans.dialect import Duck, Spark
from quire.plans.views import dialect, prefix

TABLES = ["documents", "pages", "benchmark", "labels", "conversations", "events", "orders", "lineitem", "customer", "part", "supplier", "nation", "region"]
Query = Callable[[SparkSession, str], DataFrame]


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the tables of a folder; only the tables that it names are opened."""
    for t in TABLES:
        if t in sql:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)


def _planned(make: Callable, views: list[str]) -> tuple[Query, str]:
    def text_of(d) -> str:
        return f"{prefix(d, views)} {make(d)}" if views else f"WITH {make(d)}"

    return (lambda spark, sf_dir: run_sql(spark, sf_dir, text_of(dialect(spark, sf_dir) if views else Spark()))), text_of(Duck())


def _collect() -> dict[str, tuple[Query, str | None]]:
    found: dict[str, tuple[Query, str | None]] = {}
    for module in (text, census, windows, joins, blocks, gates, reports, runs):
        for name, (views, make) in module.OPERATORS.items():
            found[name] = _planned(make, views)
    found |= arrow.QUERIES | folds.QUERIES
    for queries, oracles in ((layout_queries.QUERIES, layout_oracles.ORACLES), (prose_queries.QUERIES, prose_oracles.ORACLES)):
        found |= {name: (query, oracles.get(name)) for name, query in queries.items()}
    return found


QUERIES = _collect()
FLAGSHIP: Query = QUERIES["furniture_templates"][0]


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
