"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan of one table; columns and filters chosen later reach the Parquet reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
