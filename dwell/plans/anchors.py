"""The anchor engine: official percentiles of a stream, moved by what a cohort of cases says."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.functions import rules
from dwell.operators import models, survival
from dwell.sources import files

# The prior of the shrinkage, the bounds of the ratio, the parts of the confidence score.
PRIOR, LOW, HIGH, LEAST_BROAD = 80.0, 0.5, 2.0, 30
ANCHOR_SCORE, SAMPLE_MOST, EVENTS_MOST, QUALITY_MOST, RECENCY_MOST, BIAS_PENALTY, SCORE_MOST = 40, 20, 10, 10, 10, 15, 80
GRADES = ((85, "A"), (70, "B"), (50, "C"), (0, "D"))
ANCHOR_COLUMNS = ["stream", "percentile_50_days", "percentile_90_days", "snapshot_date", "official_page_updated", "source_url"]
FILTERS = ["education_level", "study_sector", "submit_location", "includes_partner", "is_diy", "provider_group", "field_of_study_group"]


class MissingAnchor(ValueError):
    """A stream has no official percentiles in days."""


def load_anchors(spark: SparkSession, path: str) -> DataFrame:
    """(stream, p50, p90, snapshot_date, page_updated, source_url): the last row of each stream that has both percentiles."""
    rows = files.read_csv(spark, path, ANCHOR_COLUMNS).withColumn("line", F.monotonically_increasing_id())
    p50, p90 = F.expr("try_cast(percentile_50_days as double)"), F.expr("try_cast(percentile_90_days as double)")
    text = lambda c: F.coalesce(c, F.lit(""))
    valued = rows.select("stream", "line", p50.alias("p50"), p90.alias("p90"), text("snapshot_date").alias("snapshot_date"), text("official_page_updated").alias("page_updated"), text("source_url").alias("source_url"))
    valued = valued.where("p50 is not null and p90 is not null")
    last = F.max_by(F.struct("p50", "p90", "snapshot_date", "page_updated", "source_url"), "line")
    return valued.groupBy("stream").agg(last.alias("a")).select("stream", "a.*")


def with_anchor(rows: DataFrame, anchors: DataFrame, stream: Column) -> DataFrame:
    """``rows`` with p50 and p90 of their stream; a row whose stream has no anchor is an error when it's read."""
    named = anchors.select(F.col("stream").alias("_stream"), F.col("p50").alias("_p50"), F.col("p90").alias("_p90"))
    joined = rows.withColumn("_of", stream).join(named, F.col("_of") == F.col("_stream"), "left")
    missing = F.raise_error(F.concat(F.lit("no official percentiles for the stream "), F.coalesce("_of", F.lit("(none)"))))
    checked = lambda c: F.when(F.col("_stream").isNull(), missing.cast("double")).otherwise(F.col(c))
    return joined.select(*rows.columns, checked("_p50").alias("p50"), checked("_p90").alias("p90"))


def matching(filters: dict[str, str]) -> Column:
    """Whether a row has the asked values; blank, unknown and any ask for nothing."""
    asked = {c: v for c, v in filters.items() if str(v or "").strip().lower() not in ("", "unknown", "any")}
    out = F.lit(True)
    for c, v in asked.items():
        out = out & F.coalesce(F.col(c) == F.lit(v), F.lit(False))
    return out


def ratio_of(target: Column, broad: Column) -> Column:
    """The ratio of two medians within its bounds, 1 without either."""
    return F.when((target != 0) & (broad > 0), F.least(F.lit(HIGH), F.greatest(F.lit(LOW), target / broad))).otherwise(F.lit(1.0))


def shrunk(ratio: Column, size: Column) -> Column:
    """The ratio pulled to 1 by the effective size of its sample."""
    return F.exp(F.log(ratio) * (size / (size + F.lit(PRIOR))))


def _median(rows: DataFrame) -> float | None:
    return survival.crossings(survival.km_curve(rows, weight="weight"), None, (0.5,)).first()["p50"]


def weighted(observations: DataFrame, reference) -> DataFrame:
    return observations.withColumn("weight", survival.weights(F.col("as_of"), F.col("quality"), F.col("source_quality_tier"), F.lit(str(reference)).cast("date")))


def cohort_adjustment(observations: DataFrame, filters: dict[str, str], reference) -> dict:
    """Sizes and medians of the asked cohort and of its sector, the ratio and the multiplier it shrinks to.

    ``observations`` has days, event, as_of, quality and source_quality_tier; reference is the date that
    weights look back from. A sector of fewer than 30 rows counts as all rows.
    """
    rows = weighted(observations, reference)
    target = rows.where(matching(filters))
    sector = filters.get("study_sector", "")
    broad = rows.where(F.col("study_sector") == sector) if sector else rows
    if sector and broad.limit(LEAST_BROAD).count() < LEAST_BROAD:
        broad = rows
    size = target.agg(F.count("*").alias("n"), F.coalesce(F.sum("event"), F.lit(0)).alias("events"), survival.effective_size(F.col("weight")).alias("n_eff"), F.avg("quality").alias("quality"), F.max("as_of").alias("latest")).first()
    own, wide = _median(target), _median(broad)
    raw = min(HIGH, max(LOW, own / wide)) if own and wide and wide > 0 else 1.0
    shrinkage = size["n_eff"] / (size["n_eff"] + PRIOR)
    return {
        "target_rows": size["n"], "target_events": size["events"], "effective_sample_size": size["n_eff"], "crowd_target_median_days": own, "crowd_broad_median_days": wide,
        "raw_crowd_ratio": raw, "shrinkage_weight": shrinkage, "multiplier": math.exp(math.log(raw) * shrinkage), "mean_quality": size["quality"] or 0.0, "latest": size["latest"],
    }


def multiplier_interval(target: DataFrame, broad_median: float | None, runs: int = 160, least: int = 20, coarse: str = "lodged", fine: str = "line_no") -> tuple[float, float] | None:
    """The 2.5 % and 97.5 % nearest ranks of the multiplier over resamples of a cohort of weighted rows.

    None without a broad median, for fewer than ``least`` rows, or as few resamples with a median. Draws
    come from hashes of run and number, so they're the same in every run of the job.
    """
    if not broad_median or target.limit(least).count() < least:
        return None
    numbered = survival.dense_index(target.select(coarse, fine, "days", "event", "weight"), coarse, fine).select("idx", "days", "event", "weight")
    total = numbered.agg(F.count("*").alias("n"))
    draws = numbered.select(F.col("idx").alias("draw")).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).join(F.broadcast(total))  # one row
    drawn = draws.select("run", F.pmod(F.xxhash64("run", "draw"), F.col("n")).alias("idx")).join(numbered, "idx")
    medians = survival.crossings(survival.km_curve(drawn, ["run"], weight="weight"), ["run"], (0.5,))
    sizes = drawn.groupBy("run").agg(survival.effective_size(F.col("weight")).alias("n_eff"))
    found = medians.join(sizes, "run").where("p50 <> 0").select(shrunk(ratio_of(F.col("p50"), F.lit(float(broad_median))), F.col("n_eff")).alias("m"))
    values = sorted(r["m"] for r in found.collect())  # one a run
    if len(values) < least:
        return None
    return values[int(0.025 * (len(values) - 1))], values[int(0.975 * (len(values) - 1))]


def confidence_parts(n_eff: Column, events: Column, mean_quality: Column, recency_days: Column) -> dict[str, Column]:
    """The parts of the evidence score of an anchored forecast as expressions; a backtest never adds to it."""
    whole = lambda c: F.floor(c).cast("int")
    return {
        "official_anchor": F.lit(ANCHOR_SCORE), "effective_sample": F.least(F.lit(SAMPLE_MOST), whole(n_eff / 10)), "observed_events": F.least(F.lit(EVENTS_MOST), whole(events / 10)),
        "row_quality": F.least(F.lit(QUALITY_MOST), F.bround(mean_quality / 10, 0).cast("int")), "recency": F.greatest(F.lit(0), F.lit(RECENCY_MOST) - whole(F.greatest(F.lit(0), recency_days) / 60)),
        "backtest_calibration": F.lit(0), "self_selection_bias_penalty": F.lit(-BIAS_PENALTY),
    }


def confidence_score(parts: dict[str, Column]) -> Column:
    total = F.lit(0)
    for c in parts.values():
        total = total + c
    return F.least(F.lit(SCORE_MOST), F.greatest(F.lit(0), total))


def grade(score: Column) -> Column:
    out = F.lit(GRADES[-1][1])
    for least, name in reversed(GRADES[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def pick_evaluation(artifact: dict | None) -> dict | None:
    """What an artifact says of backtests: its own, or the first evaluation of the model it selected."""
    if not artifact:
        return None
    if artifact.get("retrospective_backtest") is not None:
        return artifact["retrospective_backtest"]
    if not artifact.get("evaluations"):
        return None
    name = artifact.get("selected_baseline")
    chosen = next((e for e in artifact["evaluations"] if e.get("model") == name), None)
    return {"time_split": artifact.get("time_split"), "selected_baseline": name, "selected_evaluation": chosen}


def forecast(spark: SparkSession, observations: DataFrame, anchors: DataFrame, lodged: datetime, current: datetime, filters: dict[str, str], artifact: dict | None = None) -> dict:
    """An anchored forecast of one request; ``current`` before ``lodged`` counts as ``lodged``.

    ``observations`` come from jobs.observations, ``anchors`` from load_anchors. A sector whose stream
    has no anchor raises MissingAnchor.
    """
    current = max(current, lodged)
    elapsed = (current - lodged).total_seconds() / 86400
    stream = spark.range(1).select(rules.stream_for_sector(F.lit(filters.get("study_sector", "Unknown"))).alias("s")).first()["s"]
    anchor = anchors.where(F.col("stream") == stream).first()
    if anchor is None:
        raise MissingAnchor(f"no official percentiles in days for {stream!r}; choose another sector or use predict")
    reference = observations.agg(F.max("as_of")).first()[0] or current.date()
    moved = cohort_adjustment(observations, filters, reference)
    request = spark.createDataFrame([(elapsed, anchor["p50"] * moved["multiplier"], anchor["p90"] * moved["multiplier"], float(moved["effective_sample_size"]), int(moved["target_events"]), float(moved["mean_quality"]), (reference - (moved["latest"] or reference)).days)], "elapsed double, p50 double, p90 double, n_eff double, events long, quality double, recency int")
    parts = confidence_parts(F.col("n_eff"), F.col("events"), F.col("quality"), F.col("recency"))
    row = models.lognormal_quantiles(request, "elapsed", "p50", "p90").withColumns(parts).withColumn("score", confidence_score(parts)).withColumn("grade", grade(F.col("score"))).first()
    target = weighted(observations, reference).where(matching(filters))
    interval = multiplier_interval(target, moved["crowd_broad_median_days"])
    total = {p: row["q" + p[1:]] for p in ("p10", "p50", "p80", "p90")}
    dates = {p: (lodged + timedelta(days=d)).isoformat(timespec="minutes") for p, d in total.items()}
    return {
        "lodged_at": lodged.isoformat(timespec="minutes"), "as_of": current.isoformat(timespec="minutes"), "elapsed_days": round(elapsed, 3), "predicted_decision_at": dates,
        "remaining_days": {p: round(max(0.0, d - elapsed), 1) for p, d in total.items()}, "predictive_interval": {"level": "80%", "low": dates["p10"], "high": dates["p90"]},
        "median_parameter_uncertainty": interval and {"median_model_days_low": round(anchor["p50"] * interval[0], 1), "median_model_days_high": round(anchor["p50"] * interval[1], 1)},
        "data_confidence": {"score": row["score"], "grade": row["grade"], "components": {n: row[n] for n in parts}},
        "official_anchor": anchor.asDict() | {"adjusted_p50_days": round(row["p50"], 2), "adjusted_p90_days": round(row["p90"], 2)},
        "crowd_adjustment": {k: v for k, v in moved.items() if k not in ("mean_quality", "latest")}, "filters": filters, "backtest": pick_evaluation(artifact),
    }


def retrospective_backtest(observations: DataFrame, cutoff: str) -> DataFrame:
    """One row: quantiles of the weighted curve as of ``cutoff`` against the decisions that came after it.

    The median error is the upper middle one; without later decisions or a quantile the scores are null.
    """
    cut = F.lit(cutoff).cast("date")
    known = F.coalesce((F.col("event") == 1) & (F.col("decided") <= cut), F.lit(False))
    rows = observations.where(F.col("lodged") <= cut)
    train = rows.select(F.when(known, F.col("days")).otherwise(F.datediff(cut, "lodged")).cast("double").alias("days"), known.cast("int").alias("event"), F.when(known, F.col("as_of")).otherwise(cut).alias("as_of"), "quality", "source_quality_tier")
    q = survival.crossings(survival.km_curve(weighted(train, cutoff), weight="weight"))
    late = rows.where((F.col("event") == 1) & (F.col("decided") > cut)).select(F.col("days").cast("double").alias("actual")).join(F.broadcast(q))  # one row
    # an error a whole day at most: distinct ones are few
    counts = late.groupBy(F.abs(F.col("actual") - F.col("p50")).alias("error"), F.col("actual").between(F.col("p10"), F.col("p90")).alias("inside")).count()
    errors = F.array_sort(F.flatten(F.collect_list(F.array_repeat("error", F.col("count").cast("int")))))
    scores = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("test_events"), F.expr("sum(if(inside, count, 0)) / sum(count)").alias("coverage"), F.get(errors, F.floor(F.size(errors) / 2).cast("int")).alias("median_error"))
    return q.join(F.broadcast(scores))


def train_anchor_model(spark: SparkSession, observations: DataFrame, anchors: DataFrame, output: str, cutoff: str = "2025-12-31") -> dict:
    """Write the anchor engine's artifact: sizes, settings, anchors and the retrospective backtest."""
    size = observations.agg(F.max("as_of").alias("reference"), F.count("*").alias("n"), F.coalesce(F.sum("event"), F.lit(0)).alias("events")).first()
    found = retrospective_backtest(observations, cutoff).first().asDict()
    state = {
        "dataset_snapshot_date": str(size["reference"]), "training_rows_after_quality_and_dedup": size["n"], "observed_events": size["events"], "right_censored": size["n"] - size["events"],
        "hyperparameters": {"recency_half_life_days": 540, "cohort_shrinkage_prior_effective_n": PRIOR, "crowd_ratio_cap": [LOW, HIGH], "quality_threshold": 40},
        "official_anchors": {r["stream"]: r.asDict() for r in anchors.collect()},  # one row a stream
        "retrospective_backtest": {"cutoff": cutoff} | (found if found["median_error"] is not None and None not in (found["p10"], found["p50"], found["p90"]) else {"test_events": found["test_events"], "status": "insufficient"}),
    }
    files.write_artifact(spark, output, state)
    return state
