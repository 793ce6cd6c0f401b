"""Reading of tables, and the package's place for Python workers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def find_package(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; on a cluster it is sent with --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
