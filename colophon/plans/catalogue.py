"""All registered queries over the standard tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colophon.plans import facts, registry, rules, snapshots, texts  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.QUERIES["r_facets"](spark, sf_dir)


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
