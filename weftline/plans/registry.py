"""Query and oracle registry of the core engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import base
from weftline.plans import dedup_queries, io_queries, table_queries, text_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.QUERIES["rule_counts"](spark, sf_dir)


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)
