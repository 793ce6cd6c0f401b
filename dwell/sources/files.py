"""File tables: CSV of text columns, JSON artifacts, digests, and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the store that Spark reads it from."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV table of text cells with a header; a missing file is an empty table, missing columns are null."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    found = spark.read.csv(path, header=True, enforceSchema=False, multiLine=True, escape='"')
    # columns go by name, as header order may differ
    return found.select(*[found[f"`{c}`"].cast("string").alias(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in columns])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_artifact(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_artifact(spark: SparkSession, path: str, state: dict) -> None:
    """One JSON document, put in place by a rename."""
    write_text(spark, path, json.dumps(state, ensure_ascii=False, sort_keys=True, indent=2))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One text file, put in place by a rename."""
    jvm = spark._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    fs.rename(part, target)


def append(rows: DataFrame, path: str) -> None:
    """Add to a log that keeps all history."""
    rows.write.mode("append").parquet(path)


def write_vintage(rows: DataFrame, path: str, by: str = "source_snapshot_date") -> None:
    """Replace the vintages that ``rows`` holds and leave the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upsert_table(new: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Replace rows of equal keys in the Parquet table at ``path`` and add the others.

    The result is written beside the table, then renamed into its place, as a table can't be
    overwritten while it is read.
    """
    from dwell.operators.flows import upsert

    spark = new.sparkSession
    rows = upsert(spark.read.parquet(path), new, keys) if exists(spark, path) else new
    rows.write.mode("overwrite").parquet(path + ".part")
    jvm = spark._jvm
    target, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(target, True)
    fs.rename(part, target)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)
