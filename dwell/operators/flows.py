"""Monthly activity series: features, revisions, grain checks, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _index(month: str):
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")


def _latest(flows: DataFrame, order: str | None) -> tuple[DataFrame, str]:
    return (flows, order) if order else (flows.withColumn("_order", F.monotonically_increasing_id()), "_order")


def flow_features(flows: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each month: lodged, granted, net, ratio, and lodged over three calendar months.

    Of repeated months and types the last row by ``order`` counts (without it, as they are read).
    """
    flows, order = _latest(flows, order)
    both = flows.groupBy("activity_month").pivot("activity_type", ["lodged", "granted"]).agg(F.max_by("count", order).cast("double")).na.fill(0.0)
    trailing = Window.orderBy("m").rangeBetween(-2, 0)  # one row a month: small
    ratio = F.when(F.col("lodged") != 0, F.col("granted") / F.col("lodged")).otherwise(0.0)
    return both.withColumn("m", _index("activity_month")).select(
        "activity_month", "lodged", "granted", (F.col("lodged") - F.col("granted")).alias("net"), ratio.alias("grant_lodged_ratio"), F.sum("lodged").over(trailing).alias("trailing_3m_lodged"))


def lagged(rows: DataFrame, date: str, features: DataFrame, when=None) -> DataFrame:
    """``rows`` with the features of the month before ``date``, zeros without one, and flow_available."""
    names = [c for c in features.columns if c != "activity_month"]
    prior = features.select(_index("activity_month").alias("_m"), *[F.col(c).alias(f"lag1_{c}") for c in names])
    same = F.col("_m") == F.year(date) * 12 + F.month(date) - 1
    out = rows.join(F.broadcast(prior), same if when is None else same & when, "left")  # one row a month
    return out.withColumn("flow_available", F.col("_m").isNotNull().cast("double")).drop("_m").na.fill(0.0, [f"lag1_{c}" for c in names])


def revisions(current: DataFrame, prior: DataFrame, order: str | None = None) -> DataFrame:
    """Months of both vintages whose count has changed; of repeated prior rows the last by ``order``."""
    prior, order = _latest(prior, order)
    old = prior.groupBy("activity_month", "activity_type").agg(F.max_by("count", order).alias("prior_count"))
    new = current.select("activity_month", "activity_type", F.col("count").alias("new_count"))
    return new.join(old, ["activity_month", "activity_type"]).where("new_count <> prior_count").withColumn("difference", F.col("new_count") - F.col("prior_count"))


def revision_log(current: DataFrame, prior: DataFrame, detected_at: str, order: str | None = None) -> DataFrame:
    """The revisions with when they were seen, and the vintages and files that both counts come from."""
    prior, order = _latest(prior, order)
    last = F.max_by(F.struct(F.col("count").alias("prior_count"), F.col("source_snapshot_date").alias("prior_snapshot_date"), F.col("source_file_sha256").alias("prior_source_sha256")), order)
    old = prior.groupBy("activity_month", "activity_type").agg(last.alias("o")).select("activity_month", "activity_type", "o.*")
    new = current.select("activity_month", "activity_type", F.col("count").alias("new_count"), F.col("source_snapshot_date").alias("new_snapshot_date"), F.col("source_file_sha256").alias("new_source_sha256"))
    both = new.join(old, ["activity_month", "activity_type"]).where(F.col("new_count") != F.coalesce("prior_count", F.lit(0)))
    return both.select(
        F.lit(detected_at).alias("detected_at"), "prior_snapshot_date", "new_snapshot_date", "activity_month", "activity_type", "prior_count", "new_count",
        (F.col("new_count") - F.coalesce("prior_count", F.lit(0))).alias("difference"), "prior_source_sha256", "new_source_sha256")


def validation_issues(flows: DataFrame, first: str, last: str, vintage: str = "source_snapshot_date") -> DataFrame:
    """(issue, detail) of a vintage of flows: repeated grain, negative counts, types, repeated months, coverage.

    The types are judged over the whole table, so an empty one lacks them; coverage must start at
    ``first`` and reach ``last``.
    """
    grain = F.concat_ws("|", vintage, "activity_month", "activity_type")
    one = lambda name, detail: [F.lit(name).alias("issue"), detail.alias("detail")]
    repeated = flows.groupBy(vintage, "activity_month", "activity_type").count().where("count > 1").select(*one("duplicate_grain", grain))
    negative = flows.where("`count` < 0").select(*one("negative_count", grain))
    types = flows.agg(F.array_sort(F.collect_set("activity_type")).alias("t")).where(~F.col("t").eqNullSafe(F.array(F.lit("granted"), F.lit("lodged")))).select(*one("missing_activity_type", F.lit("")))
    months = flows.groupBy("activity_type").agg(F.count("*").alias("n"), F.count_distinct("activity_month").alias("m"), F.min("activity_month").alias("lo"), F.max("activity_month").alias("hi"))
    twice = months.where("n > m").select(*one("duplicate_month", F.col("activity_type")))
    short = months.where((F.col("lo") != first) | (F.col("hi") < last)).select(*one("unexpected_coverage", F.concat_ws(":", "activity_type", "lo", "hi")))
    return repeated.union(negative).union(types).union(twice).union(short)


def grain_issues(flows: DataFrame, first: str, last: str) -> DataFrame:
    """(issue, detail): repeated grain, negative counts, missing types, and short coverage."""
    repeated = flows.groupBy("activity_month", "activity_type").count().where("count > 1").select(F.lit("duplicate_grain").alias("issue"), F.concat_ws("/", "activity_month", "activity_type").alias("detail"))
    negative = flows.where("count < 0").select(F.lit("negative_count"), F.concat_ws("/", "activity_month", "activity_type"))
    types = flows.groupBy("activity_month").agg(F.array_sort(F.collect_set("activity_type")).alias("t")).where(F.size("t") < 2).select(F.lit("missing_type"), "activity_month")
    span = flows.groupBy("activity_type").agg(F.min("activity_month").alias("lo"), F.max("activity_month").alias("hi"))
    short = span.where((F.col("lo") != first) | (F.col("hi") < last)).select(F.lit("coverage"), F.concat_ws(" ", "activity_type", "lo", "hi"))
    return repeated.union(negative).union(types).union(short)


def flow_rate(flows: DataFrame, by: str) -> DataFrame:
    """(by, lodged, finalised, flow_rate): finalised applications to lodged ones, null without any lodged."""
    both = flows.groupBy(by).pivot("activity_type", ["lodged", "granted"]).agg(F.sum("count")).withColumnRenamed("granted", "finalised")
    return both.withColumn("flow_rate", F.round(F.try_divide("finalised", "lodged"), 4))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with rows of equal keys replaced by ``new``, and the other new rows added."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def monthly_volume(flows: DataFrame, months: int = 30) -> DataFrame:
    """The last ``months`` months that occur, with both counts."""
    both = flows.groupBy("activity_month").pivot("activity_type", ["lodged", "granted"]).agg(F.sum("count")).na.fill(0)
    return both.orderBy(F.desc("activity_month")).limit(months)
