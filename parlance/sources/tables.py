"""Parquet sources of the workspace tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.session import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan `<folder>/<name>.parquet`; filters and columns are pushed into the scan by the planner."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Register tables as temporary views for spark.sql."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)
