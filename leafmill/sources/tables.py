"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Reads one table; a table may be one parquet file or a folder of them."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
