"""Right-censored survival curves as grouped windows.

Rows are first grouped to one row for each stratum and whole-day duration, at most a few thousand a
stratum, so the ordered windows that follow stay small however many rows come in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed weights of source tiers.
TIER_WEIGHTS = {"A": 1.0, "B": 0.9, "B-C": 0.8, "C": 0.7, "D": 0.45}


def weights(as_of: Column, quality: Column, tier: Column, reference: Column, half_life: float = 540.0) -> Column:
    """Recency, quality and tier weight of an observation."""
    age = F.greatest(F.lit(0), F.datediff(reference, as_of))
    by_tier = F.coalesce(F.create_map(*[F.lit(x) for kv in TIER_WEIGHTS.items() for x in kv])[tier], F.lit(0.5))
    return F.pow(F.lit(0.5), age / F.lit(half_life)) * F.greatest(F.lit(0.1), quality / 100.0) * by_tier


def life_table(rows: DataFrame, by: list[str] | None = None, days: str = "days", event: str = "event", weight: str | None = None) -> DataFrame:
    """by, days, events, leaving, at_risk, survival for each duration, with and without events."""
    by = by or []
    w = F.col(weight) if weight else F.lit(1.0)
    rows = rows.where((F.col(days) >= 0) & F.col(event).isin(0, 1) & (w > 0))
    cells = rows.groupBy(*by, F.col(days).cast("double").alias("days")).agg(F.sum(w * F.col(event)).alias("events"), F.sum(w).alias("leaving"))
    later = Window.partitionBy(*by).orderBy(F.desc("days")).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy("days").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("at_risk", F.sum("leaving").over(later))
    factor = F.greatest(F.lit(0.0), 1.0 - F.col("events") / F.col("at_risk"))
    return cells.withColumn("survival", F.product(factor).over(earlier))


def km_curve(rows: DataFrame, by: list[str] | None = None, **names) -> DataFrame:
    """(by, days, survival): the point (0, 1), then one at each duration with events."""
    by = by or []
    table = life_table(rows, by, **names)
    start = table.select(*by).distinct() if by else table.limit(1)
    start = start.select(*by, F.lit(0.0).alias("days"), F.lit(1.0).alias("survival"))
    return start.unionByName(table.where("events > 0").select(*by, "days", "survival"))


def crossings(curve: DataFrame, by: list[str] | None = None, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """First duration at which survival is down to 1 - share, null if it never is; columns p10, p50...

    Both are compared to twelve places, so that a curve that meets a threshold exactly crosses it there
    whatever the order of its products.
    """
    first = [F.min(F.when(F.round("survival", 12) <= F.round(F.lit(1.0 - p), 12), F.col("days"))).alias(f"p{round(100 * p)}") for p in shares]
    return curve.groupBy(*(by or [])).agg(*first)


def survival_at(curve: DataFrame, horizons: list[float], by: list[str] | None = None) -> DataFrame:
    """(by, horizon, survival): the curve's last value up to each horizon."""
    by = by or []
    asked = curve.withColumn("horizon", F.explode(F.array(*[F.lit(float(h)) for h in horizons])))
    last = F.max_by("survival", F.when(F.col("days") <= F.col("horizon"), F.struct("days", -F.col("survival"))))
    return asked.groupBy(*by, "horizon").agg(F.coalesce(last, F.lit(1.0)).alias("survival"))


def effective_size(weight: Column) -> Column:
    return F.coalesce(F.try_divide(F.pow(F.sum(weight), F.lit(2)), F.sum(weight * weight)), F.lit(0.0))


def stratified_with_fallback(rows: DataFrame, levels: list[list[str]], min_rows: int = 40, min_events: int = 15) -> DataFrame:
    """(level, key, p10, p50, p90) for each stratum that is large enough at each level of ``levels``; key is a JSON text.

    The last level should be empty: it stands for all rows and always qualifies.
    """
    out = None
    for n, by in enumerate(levels):
        size = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("event").alias("e"))
        keep = size.where((F.col("n") >= min_rows) & (F.col("e") >= min_events)) if by else size
        curve = crossings(km_curve(rows, by), by)
        found = curve.join(keep.select(*by), by, "left_semi") if by else curve
        found = found.select(F.lit(n).alias("level"), F.concat_ws("|", *by).alias("key") if by else F.lit("").alias("key"), "p10", "p50", "p90")
        out = found if out is None else out.unionByName(found)
    return out


def dense_index(rows: DataFrame, coarse: str, fine: str, name: str = "idx") -> DataFrame:
    """Numbers from 0 in the order of (coarse, fine) without one task for all rows.

    Rows are numbered within each value of ``coarse``, then moved by the counts before it.
    """
    before = Window.orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    moved = rows.groupBy(coarse).count().select(coarse, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(coarse).orderBy(fine))
    return rows.withColumn("_n", within).join(moved, coarse).withColumn(name, F.col("_before") + F.col("_n") - 1).drop("_n", "_before")


def bootstrap_medians(rows: DataFrame, runs: int, coarse: str = "lodged", fine: str = "case_id") -> DataFrame:
    """(run, p50): medians of resamples of as many rows, drawn by a hash of run and draw number."""
    numbered = dense_index(rows.select(coarse, fine, "days", "event"), coarse, fine).select("idx", "days", "event")
    total = numbered.agg(F.count("*").alias("n"))
    draws = numbered.select(F.col("idx").alias("draw")).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).join(F.broadcast(total))
    number = F.conv(F.substring(F.sha2(F.concat_ws("-", "run", "draw"), 256), 1, 8), 16, 10).cast("long")
    drawn = draws.select("run", (number % F.col("n")).alias("idx")).join(numbered, "idx")
    return crossings(km_curve(drawn, ["run"]), ["run"], (0.5,))


def nearest_rank(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: element int(share * (n - 1)) of the ordered values, for each name."""
    ordered = F.array_sort(F.collect_list(column))
    return values.agg(*[F.element_at(ordered, F.floor(F.lit(p) * (F.size(ordered) - 1)).cast("int") + 1).alias(n) for n, p in shares.items()])


def logrank(rows: DataFrame, group: str) -> DataFrame:
    """(group, observed_minus_expected, variance, score): each group against the rest, hypergeometric variance."""
    everyone = life_table(rows).where("events > 0").select("days", F.col("events").alias("d"), F.col("at_risk").alias("r"))
    cells = rows.groupBy(group, F.col("days").cast("double").alias("days")).agg(F.sum(F.lit(1.0)).alias("n"), F.sum(F.col("event") * F.lit(1.0)).alias("e"))
    grid = everyone.join(F.broadcast(cells.select(group).distinct()))
    points = grid.select(group, "days", "d", "r", F.lit(0.0).alias("n"), F.lit(0.0).alias("e")).unionByName(cells.select(group, "days", F.lit(None).cast("double").alias("d"), F.lit(None).cast("double").alias("r"), "n", "e"))
    per_day = points.groupBy(group, "days").agg(F.max("d").alias("d"), F.max("r").alias("r"), F.sum("n").alias("n"), F.sum("e").alias("e"))
    later = Window.partitionBy(group).orderBy(F.desc("days")).rowsBetween(Window.unboundedPreceding, 0)
    per_day = per_day.withColumn("own", F.sum("n").over(later)).where("d is not null")
    expected = F.col("d") * F.col("own") / F.col("r")
    spread = F.when(F.col("r") > 1, expected * (1 - F.col("own") / F.col("r")) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    total = per_day.groupBy(group).agg(F.sum(F.col("e") - expected).alias("observed_minus_expected"), F.sum(spread).alias("variance"))
    return total.withColumn("score", F.when(F.col("variance") > 0, F.pow("observed_minus_expected", F.lit(2)) / F.col("variance")).otherwise(0.0))
