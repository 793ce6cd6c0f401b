"""The tables behind the charts; drawing is left to a charting tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.operators import survival
from dwell.plans import jobs
from dwell.sources import files


def case_volume(rows: DataFrame, months: int = 30) -> DataFrame:
    """(month, lodged, granted): the last ``months`` months in which a case was lodged or decided."""
    dated = F.array(F.struct(F.lit(1).alias("lodged"), F.lit(0).alias("granted"), F.col("lodgement_date").alias("d")), F.struct(F.lit(0).alias("lodged"), F.lit(1).alias("granted"), F.col("decision_date").alias("d")))
    x = rows.select(F.explode(dated).alias("x")).select("x.*").where("coalesce(d, '') <> ''")
    counts = x.groupBy(F.substring("d", 1, 7).alias("month")).agg(F.sum("lodged").alias("lodged"), F.sum("granted").alias("granted"))
    return counts.orderBy(F.desc("month")).limit(months).orderBy("month")


def backtest_scores(spark: SparkSession, artifact: dict) -> DataFrame:
    """(model, harrell_c_index, brier_180) of an artifact's holdout evaluations, or else of its evaluations."""
    found = artifact.get("holdout_evaluations") or artifact.get("evaluations") or []
    return spark.createDataFrame([(e.get("model", "unknown"), float(e.get("harrell_c_index") or 0), float(e.get("brier_180") or 0)) for e in found], "model string, harrell_c_index double, brier_180 double")


def write_tables(spark: SparkSession, cases: str, output: str, artifact: dict | None = None) -> dict:
    """Write survival, volume and (with an artifact) backtest under ``output``; the rows of each."""
    tables = {"survival": survival.km_curve(jobs.observations(spark, cases)).orderBy("days"), "volume": case_volume(files.read_csv(spark, cases, jobs.CASE_COLUMNS))}
    if artifact:
        tables["backtest"] = backtest_scores(spark, artifact)
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").csv(f"{output}/{name}", header=True)  # at most a row a day, month or model
    return {name: table.count() for name, table in tables.items()}
