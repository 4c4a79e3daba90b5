"""Parquet snapshot readers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# The table names of the driver's test snapshot.
TEST_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

TPCH_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_tables(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: read_table(spark, sf_dir, n) for n in (names or TEST_TABLES)}


def database_name_of(sf_dir: str) -> str:
    """A snapshot directory stands for one database; its base name is the database name."""
    return os.path.basename(os.path.normpath(sf_dir))
