"""Time splits and the evaluation of predictions on held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def time_split(rows: DataFrame, cutoff: str, test_end: str) -> DataFrame:
    """``rows`` with split, duration and observed: training outcomes after the cutoff are censored at it."""
    cut, end = F.lit(cutoff).cast("date"), F.lit(test_end).cast("date")
    train = F.col("lodged") <= cut
    known = (F.col("event") == 1) & (F.col("decided") <= cut)
    days = F.when(train, F.datediff(F.when(known, F.col("decided")).otherwise(cut), "lodged")).otherwise(F.col("days"))
    return rows.where(F.col("lodged") <= end).select(
        "*", F.when(train, "train").otherwise("test").alias("split"), F.greatest(F.lit(0.5), days.cast("double")).alias("duration"),
        F.when(train, F.coalesce(known, F.lit(False)).cast("int")).otherwise(F.col("event")).alias("observed"))


def concordance(rows: DataFrame, duration: str, event: str, risk: str) -> DataFrame:
    """One row: Harrell's C and the comparable pairs, without a row for any pair.

    Distinct durations (whole days: a few thousand) are numbered in order. Two cells of different number
    lie in the two halves of exactly one binary block of numbers, so each (duration, risk) cell counts
    once a level: there an event in the lower half meets all in the upper half, of which those of lower
    risk are a running sum over risk. Cells grow to cells times levels, never to pairs.
    """
    cells = rows.groupBy(F.col(duration).alias("d"), F.col(risk).alias("r")).agg(F.count("*").alias("n"), F.sum(event).alias("e"))
    # one row a duration
    days = cells.select("d").distinct().withColumn("k", F.row_number().over(Window.orderBy("d")) - 1)
    days = days.withColumn("levels", F.length(F.bin(F.max("k").over(Window.partitionBy()))))
    levels = cells.join(days, "d").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels") - 1)))
    block, upper = F.expr("shiftright(k, level + 1)"), F.expr("shiftright(k, level) & 1")
    sums = levels.groupBy("level", block.alias("block"), "r").agg(F.sum(F.when(upper == 0, F.col("e")).otherwise(0)).alias("events"), F.sum(F.when(upper == 1, F.col("n")).otherwise(0)).alias("after"))
    lower = Window.partitionBy("level", "block").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("level", "block")
    sums = sums.select("events", "after", F.coalesce(F.sum("after").over(lower), F.lit(0)).alias("below"), F.sum("after").over(whole).alias("all"))
    total = sums.agg(F.coalesce(F.sum(F.col("events") * F.col("all")), F.lit(0)).alias("comparable_pairs"), F.sum(F.col("events") * (F.col("below") + 0.5 * F.col("after"))).alias("w"))
    return total.select("comparable_pairs", F.try_divide("w", "comparable_pairs").alias("harrell_c_index"))


def evaluate_model(scored: DataFrame, name: str, horizons: tuple[float, ...] = (90.0, 180.0, 365.0)) -> DataFrame:
    """One row of everything that is reported of a model: ``scored`` has duration, observed, risk, p10 to p90 and s_<horizon>.

    Errors and coverage are over events with the quantiles they need; for Brier scores a row censored
    before a horizon counts as not decided by then. No rows: counts of 0 and nulls.
    """
    event = F.col("observed") == 1
    both = event & F.col("p10").isNotNull() & F.col("p90").isNotNull()
    scores = [
        F.count("*").alias("test_rows"), F.count_if(event).alias("test_events"), F.count_if(~event).alias("test_censored"),
        F.round(F.median(F.when(event, F.abs(F.col("duration") - F.col("p50")))), 1).alias("event_only_median_absolute_error_days"),
        F.round(F.avg(F.when(both, F.col("duration").between(F.col("p10"), F.col("p90")).cast("double"))), 4).alias("event_only_p10_p90_coverage"), F.count_if(both).alias("event_only_interval_rows"),
    ]
    for h in horizons:
        chance, actual = 1.0 - F.col(f"s_{h:g}"), F.when(event & (F.col("duration") <= h), 1.0).otherwise(0.0)
        scores += [F.round(F.avg(F.pow(chance - actual, F.lit(2))), 4).alias(f"brier_{h:g}"), F.round(F.avg(chance), 4).alias(f"mean_predicted_{h:g}"), F.round(F.avg(actual), 4).alias(f"observed_fraction_{h:g}"), F.round(F.avg(chance) - F.avg(actual), 4).alias(f"calibration_gap_{h:g}")]
    c = concordance(scored, "duration", "observed", "risk").select(F.round("harrell_c_index", 4).alias("harrell_c_index"), F.col("comparable_pairs").cast("long").alias("comparable_pairs"))
    return scored.agg(*scores).join(F.broadcast(c)).select(F.lit(name).alias("model"), "*")  # one row each


def horizon_scores(rows: DataFrame, predictions: DataFrame, on: list[str], duration: str = "duration", event: str = "observed") -> DataFrame:
    """(horizon, brier, mean_predicted, observed_fraction, calibration_gap); ``predictions``: on, horizon, survival.

    Rows censored before a horizon count as not decided by then.
    """
    joined = rows.join(F.broadcast(predictions), on) if on else rows.join(F.broadcast(predictions))
    actual = F.when((F.col(event) == 1) & (F.col(duration) <= F.col("horizon")), 1.0).otherwise(0.0)
    chance = 1.0 - F.col("survival")
    return joined.groupBy("horizon").agg(F.avg(F.pow(chance - actual, F.lit(2))).alias("brier"), F.avg(chance).alias("mean_predicted"), F.avg(actual).alias("observed_fraction"), (F.avg(chance) - F.avg(actual)).alias("calibration_gap"))


def interval_scores(rows: DataFrame, duration: str = "duration", event: str = "observed") -> DataFrame:
    """One row over events: median absolute error of p50, and how often p10 to p90 covers; null bounds are left out."""
    events = rows.where(F.col(event) == 1)
    both = F.col("p10").isNotNull() & F.col("p90").isNotNull()
    covered = F.col(duration).between(F.col("p10"), F.col("p90")).cast("double")
    return events.agg(F.median(F.abs(F.col(duration) - F.col("p50"))).alias("median_absolute_error"), F.avg(F.when(both, covered)).alias("coverage"), F.count_if(both).alias("interval_rows"))
