"""Event streams: daily tumbling counts, dedup by id with a watermark, sessions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.sources.tables import find_package


def open_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A stream over the files of a table, with its schema."""
    find_package(spark)
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path[:-1] + "[" + path[-1] + "]")


def first_by_id(events: DataFrame, key: str = "event_id", time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first event of each id; state is kept for ``late`` of event time."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """(day, kind, n, total) in tumbling days."""
    counts = events.groupBy(F.window(time, "1 day").alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return counts.select(F.to_date("w.start").alias("day"), kind, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", time: str = "ts") -> DataFrame:
    """(key, first_ts, n) of each run of events less than ``gap`` apart; for batches and streams."""
    return events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.min(time).alias("first_ts"), F.count("*").alias("n")).drop("w")


def daily_counts_of(spark: SparkSession, folder: str, store: str | None = None) -> DataFrame:
    """Daily counts of all events that are there now, run as a stream to its end.

    Each batch's changed days are appended to a table of files under ``store`` (by default the
    warehouse), so nothing is gathered in the driver; of a day the last batch's counts stand.
    """
    place = f"{store or spark.conf.get('spark.sql.warehouse.dir')}/daily_{uuid.uuid4().hex}"
    counted = daily_counts(open_stream(spark, folder).withColumn("ts", F.col("ts").cast("timestamp")))
    write = lambda rows, batch: rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(f"{place}/rows")
    run = counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema("day date, event_type string, n long, total double, batch long").parquet(f"{place}/rows")
    last = F.max_by(F.struct("n", "total"), "batch")
    return rows.groupBy("day", "event_type").agg(last.alias("x")).select("day", "event_type", "x.*")
