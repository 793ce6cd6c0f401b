"""Dedup, validation, audit and profile of case tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_quality(rows: DataFrame, key: str, quality: str, order: str) -> DataFrame:
    """The row of highest quality for each key; the first in ``order`` of equal ones."""
    best = F.min_by(F.struct(*[f"`{c}`" for c in rows.columns]), F.struct(F.col(quality).isNull(), -F.col(quality), F.col(order)))
    return rows.groupBy(F.col(key).alias("_key")).agg(best.alias("_row")).select("_row.*")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row in ``order`` for each key; rows without a key all stay."""
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    first = F.min_by(F.struct(*[f"`{c}`" for c in rows.columns]), F.col(order))
    named = rows.where(~blank).groupBy(F.col(key).alias("_key")).agg(first.alias("_row")).select("_row.*")
    return named.unionByName(rows.where(blank))


def repeats(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Every row after the first of its key, with its number among them."""
    return rows.withColumn("repeat", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("repeat > 1")


def duplicate_counts(rows: DataFrame, key: str) -> DataFrame:
    """One row: groups of more than one row, and rows in them."""
    sizes = rows.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(key).count()
    return sizes.agg(F.count_if(F.col("count") > 1).alias("groups"), F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("rows_in_groups"))


def exact_repeats(rows: DataFrame) -> DataFrame:
    """One row: rows beyond the first of each set of equal rows."""
    return rows.groupBy(*rows.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("beyond_first"))


def usable(rows: DataFrame, least: int = 40) -> Column:
    """Whether a row can enter a survival fit; all numbers present and in range."""
    return F.coalesce(F.col("waiting").between(0, 3650) & F.col("event").isin(0, 1) & (F.col("quality") >= least), F.lit(False))


def numeric(rows: DataFrame) -> Column:
    """Whether all numbers of a row are there."""
    return F.col("event").isNotNull() & F.col("waiting").isNotNull() & F.col("quality").isNotNull()


def issues(rows: DataFrame, until: Column | None = None) -> DataFrame:
    """(issue, rows): the kinds of validity issues that occur; rows without a number are skipped after the first two.

    Waiting days should reach from lodgement to ``until``, or else to the decision or the snapshot.
    """
    numeric_ = numeric(rows)
    until = F.when(F.col("event") == 1, F.col("decided")).otherwise(F.col("snapshot")) if until is None else until
    kinds = {
        "missing_or_invalid_lodgement_date": F.col("lodged").isNull(),
        "invalid_numeric_field": ~numeric_,
        "invalid_event_observed": numeric_ & ~F.col("event").isin(0, 1),
        "implausible_waiting_days": numeric_ & ~F.col("waiting").between(0, 3650),
        "future_lodgement": numeric_ & (F.col("lodged") > F.col("snapshot")),
        "decision_before_lodgement": numeric_ & (F.col("decided") < F.col("lodged")),
        "event_without_decision_date": numeric_ & (F.col("event") == 1) & F.col("decided").isNull(),
        "censored_with_decision_date": numeric_ & (F.col("event") == 0) & F.col("decided").isNotNull(),
        "waiting_days_mismatch": numeric_ & (F.col("waiting") != F.datediff(until, "lodged")),
        "status_event_mismatch": numeric_ & (F.coalesce("status", F.lit("")) != F.when(F.col("event") == 1, "granted").otherwise("pending")),
    }
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in kinds.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("issue"), F.col(n).alias("rows")) for n in kinds])).alias("x")).select("x.*").where("rows > 0")


def claimed_and_computed(rows: DataFrame) -> DataFrame:
    """``rows`` with the waiting days that are claimed and those between the dates, and whether they agree; unknown ones don't."""
    until = F.when(F.col("event") == 1, F.col("decided")).otherwise(F.col("snapshot"))
    out = rows.withColumn("claimed", F.col("waiting").cast("long")).withColumn("computed", F.datediff(until, "lodged").cast("long"))
    return out.withColumn("consistent", F.coalesce(F.col("claimed") == F.col("computed"), F.lit(False)))


def value_counts(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, row_count) of each dimension in one pass; blanks are (blank)."""
    pairs = [F.struct(F.lit(d).alias("dimension"), F.when(F.coalesce(F.col(d).cast("string"), F.lit("")) == "", "(blank)").otherwise(F.col(d).cast("string")).alias("value")) for d in dimensions]
    return rows.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("row_count"))


def flag_counts(rows: DataFrame, flags: str = "quality_flags") -> DataFrame:
    return rows.select(F.explode(F.split(flags, r"\|")).alias("flag")).where("flag <> ''").groupBy("flag").agg(F.count("*").alias("row_count"))


def unknown_rates(rows: DataFrame, fields: list[str], counted: Column | None = None) -> DataFrame:
    """(field, rate): the share of all rows in which a predictor is blank or unknown, to four places.

    With ``counted``, blanks of other rows don't count, while the rows themselves still do.
    """
    counted = F.lit(True) if counted is None else counted
    blank = lambda f: F.lower(F.trim(F.coalesce(F.col(f).cast("string"), F.lit("")))).isin("", "unknown", "(blank)")
    counts = rows.agg(F.count("*").alias("_n"), *[F.count_if(blank(f) & counted).alias(f) for f in fields])
    rate = lambda f: F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(F.round(F.col(f) / F.col("_n"), 4))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), rate(f).alias("rate")) for f in fields])).alias("x")).select("x.*")
