"""Readers for the Parquet tables of a data folder; any URI that Spark can read works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder, read lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
