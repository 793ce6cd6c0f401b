"""The pipeline's commands: collect, validate, profile, predict, audit, train, forecast, refresh."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.functions import rules
from dwell.operators import evaluate, flows, models, quality, survival
from dwell.plans import training
from dwell.plans.training import confidence, grade_of  # noqa: F401
from dwell.sources import files

# The columns of the tables and the predictors.
CASE_COLUMNS = [
    "record_id", "duplicate_key", "source_id", "source_quality_tier", "snapshot_date", "visa_subclass", "application_status", "event_observed", "lodgement_date", "decision_date", "as_of_date",
    "waiting_days", "education_level", "study_sector", "field_of_study_group", "submit_location", "includes_partner", "is_diy", "provider_group", "record_quality_score", "quality_flags", "provenance_url",
]
FLOW_COLUMNS = ["source_snapshot_date", "activity_month", "activity_type", "count", "applicant_type", "client_location", "citizenship_country", "sector", "source_resource_id", "source_last_modified", "source_file_sha256", "source_url", "extraction_method"]
#: Strata of the curves by strata, from the finest on; the last stands for all rows.
LEVELS = [["study_sector", "submit_location", "education_level"], ["study_sector", "submit_location"], []]
VERSION = "dwell-survival-1"
CATEGORIES = ["education_level", "study_sector", "submit_location", "field_of_study_group", "includes_partner", "is_diy", "provider_group"]
NUMBERS = ["lodgement_year", "lodgement_month_sin", "lodgement_month_cos", "official_flow_available", "official_lag1_lodged_log", "official_lag1_granted_log", "official_lag1_net_per_100", "official_lag1_grant_lodged_ratio", "official_lag1_trailing_3m_lodged_log"]


def typed_cases(raw: DataFrame) -> DataFrame:
    """Text cells of cases as the columns the operators work on, with a line number for ties.

    The number follows the order in which Spark reads the file, which is the file's own order.
    """
    number = lambda c: F.expr(f"try_cast({c} as int)")
    return raw.withColumn("line_no", F.monotonically_increasing_id()).select(
        "*", number("waiting_days").alias("waiting"), number("event_observed").alias("event"), number("record_quality_score").alias("quality"),
        rules.iso_date(F.col("lodgement_date")).alias("lodged"), rules.iso_date(F.col("decision_date")).alias("decided"), rules.iso_date(F.col("as_of_date")).alias("as_of"),
        rules.iso_date(F.col("snapshot_date")).alias("snapshot"), F.col("application_status").alias("status"))


def observations(spark: SparkSession, path: str, least: int = 40) -> DataFrame:
    """Usable cases, the best of each duplicate key (or record id)."""
    # durations may be parts of a day here
    rows = typed_cases(files.read_csv(spark, path, CASE_COLUMNS)).withColumn("waiting", F.expr("try_cast(waiting_days as double)"))
    rows = rows.where(quality.usable(rows, least) & F.col("lodged").isNotNull() & F.col("as_of").isNotNull())
    rows = rows.withColumn("key", F.coalesce(F.expr("nullif(duplicate_key, '')"), F.col("record_id"))).withColumn("days", F.col("waiting"))
    return quality.best_quality(rows, "key", "quality", "line_no")


def predict(spark: SparkSession, path: str, education: str | None = None, location: str | None = None, runs: int = 400) -> dict:
    """Quantiles of a cohort with a bootstrap interval of the median and a grade.

    The first row of each duplicate key counts, seen before its numbers are parsed.
    """
    rows = typed_cases(files.read_csv(spark, path, CASE_COLUMNS))
    for column, value in (("education_level", education), ("submit_location", location)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows.where("quality >= 40")
    kept = quality.first_seen(rows, "duplicate_key", "line_no")
    valid = kept.where("waiting between 0 and 3650 and event in (0, 1)").withColumn("days", F.col("waiting"))
    q = survival.crossings(survival.km_curve(valid)).first() or {"p10": None, "p50": None, "p90": None}
    size = valid.agg(F.count("*").alias("n"), F.coalesce(F.sum("event"), F.lit(0)).alias("e")).first()
    ci = survival.nearest_rank(survival.bootstrap_medians(valid, runs, "lodged", "line_no").where("p50 is not null"), "p50", {"low": 0.025, "high": 0.975}).first() if size.n else None
    censored = 1 - size.e / size.n if size.n else 1.0
    grade = "B" if size.n >= 300 and size.e >= 100 and censored <= 0.7 else "C" if size.n >= 100 and size.e >= 30 else "D"
    return {"sample_size": size.n, "observed_events": size.e, "censored_cases": size.n - size.e, "p10_days": q["p10"], "median_days": q["p50"], "p90_days": q["p90"], "median_ci_low": ci and ci.low, "median_ci_high": ci and ci.high, "confidence_grade": grade, "collapsed_rows": rows.count() - kept.count()}


def validate(spark: SparkSession, path: str) -> dict:
    header = spark.read.csv(path, header=True).columns
    rows = typed_cases(files.read_csv(spark, path, CASE_COLUMNS))
    counts = rows.agg(F.count("*").alias("rows"), F.count_if(F.coalesce("record_id", F.lit("")) == "").alias("missing_ids"), F.count_if(quality.usable(rows)).alias("usable")).first()
    repeats = quality.repeats(rows.where("record_id <> ''"), "record_id", "line_no").count()
    return counts.asDict() | {"duplicate_ids": repeats, "missing_columns": sorted(set(CASE_COLUMNS) - set(header))}


def profile(spark: SparkSession, path: str) -> DataFrame:
    rows = files.read_csv(spark, path, CASE_COLUMNS)
    counts = quality.value_counts(rows, ["application_status", *CATEGORIES])
    flags = quality.flag_counts(rows).select(F.lit("quality_flags").alias("dimension"), F.col("flag").alias("value"), "row_count")
    return counts.unionByName(flags).orderBy("dimension", F.desc("row_count"), "value")


def audit(spark: SparkSession, path: str, train_cutoff: str = "2024-12-31", test_end: str = "2025-08-31", least: int = 40) -> dict:
    """Counts, validity, uniqueness, split sizes and findings of a case table."""
    raw = files.read_csv(spark, path, CASE_COLUMNS)
    header = spark.read.csv(path, header=True).columns if files.exists(spark, path) else []
    rows = typed_cases(raw).cache()
    total = raw.count()
    groups, ids = quality.duplicate_counts(raw, "duplicate_key").first(), quality.duplicate_counts(raw, "record_id").first()
    candidates = rows.where(quality.usable(rows, least) & F.col("lodged").isNotNull() & F.col("as_of").isNotNull()).withColumn("key", F.coalesce(F.expr("nullif(duplicate_key, '')"), F.col("record_id")))
    kept = quality.best_quality(candidates, "key", "quality", "line_no")
    test = (F.col("lodged") > train_cutoff) & (F.col("lodged") <= test_end)
    split = kept.agg(F.count("*").alias("n"), F.count_if(F.col("lodged") <= train_cutoff).alias("train"), F.count_if(test).alias("test"), F.count_if(test & (F.col("event") == 1)).alias("events")).first()
    good = rows.where(quality.numeric(rows)).agg(F.count_if(F.col("quality") < least).alias("low"), F.count_if(F.col("quality") >= least).alias("good")).first()
    counts = lambda c: {r["v"]: r["count"] for r in raw.groupBy(F.coalesce(c, F.lit("(blank)")).alias("v")).count().collect()}
    invalid = {r.issue: r.rows for r in quality.issues(rows, F.col("as_of")).collect()}
    report = {
        "dataset": path, "rows": total, "columns": len(header), "column_names": header, "status_counts": counts("application_status"), "source_counts": counts("source_id"),
        "lodgement_year_counts": {str(r["y"]): r["count"] for r in rows.where("lodged is not null").groupBy(F.year("lodged").alias("y")).count().orderBy("y").collect()},
        "quality": {"below_threshold": good.low, "usable_quality": good.good, "quality_threshold": least, "usable_rate": round(good.good / total, 4) if total else 0.0},
        "uniqueness": {"duplicate_record_id_groups": ids.groups, "duplicate_record_id_rows": ids.rows_in_groups, "duplicate_timeline_groups": groups.groups, "duplicate_timeline_rows": groups.rows_in_groups,
                       "exact_duplicate_rows_beyond_first": quality.exact_repeats(raw).first()[0], "rows_after_quality_and_dedup": split.n, "collapsed_rows": candidates.count() - split.n},
        "validity_issue_counts": invalid,
        "predictor_unknown_rates": {r.field: r.rate for r in quality.unknown_rates(rows, CATEGORIES, quality.numeric(rows)).collect()},
        "temporal_split": {"train_cutoff": train_cutoff, "test_end": test_end, "training_rows": split.train, "test_rows": split.test, "test_observed_events": split.events, "test_right_censored": split.test - split.events},
    }
    days = [r["d"] for r in raw.select(F.coalesce("snapshot_date", F.lit("")).alias("d")).distinct().orderBy("d").collect()]  # one a vintage
    rows.unpersist()
    return report | {"findings": findings(report, days)}


def findings(report: dict, snapshots: list[str]) -> list[dict]:
    """What an audit's numbers mean for training, the gravest first."""
    unique, wrong = report["uniqueness"], report["validity_issue_counts"]
    dates = sum(wrong.get(k, 0) for k in ("missing_or_invalid_lodgement_date", "future_lodgement", "decision_before_lodgement", "waiting_days_mismatch"))
    out = []
    if unique["duplicate_record_id_groups"] or dates:
        out.append(("critical", "Keys repeat or timelines are invalid", {"duplicate_record_id_groups": unique["duplicate_record_id_groups"], "invalid_date_or_duration_rows": dates}, "Durations may count twice or be wrong."))
    repeated = unique["duplicate_timeline_groups"]
    out.append(("high" if repeated else "low", "Timelines may repeat", {"groups": repeated, "affected_rows": unique["duplicate_timeline_rows"], "rows_after_quality_and_dedup": unique["rows_after_quality_and_dedup"]}, "Repeated reports weigh too much unless one row a key is kept, as training does."))
    out.append(("high", "Cases carry no citizenship", {"citizenship_column_present": "citizenship_country" in report["column_names"]}, "A model of these cases holds for no single country; official flows are context only."))
    out.append(("high", "When a row became known is not recorded", {"source_ids": report["source_counts"], "snapshot_dates": snapshots}, "Outcomes can be censored at a cutoff, but what was known then can't be replayed."))
    return [dict(zip(("severity", "finding", "evidence", "impact"), f)) for f in out]


def audit_markdown(report: dict) -> str:
    """An audit report as a Markdown text."""
    split, unique = report["temporal_split"], report["uniqueness"]
    summary = {"Raw rows": report["rows"], "Rows after quality filter and dedup": unique["rows_after_quality_and_dedup"], "Groups of repeated timelines": unique["duplicate_timeline_groups"],
               "Test window": f"{split['train_cutoff']} to {split['test_end']}", "Test rows / events / censored": f"{split['test_rows']} / {split['test_observed_events']} / {split['test_right_censored']}"}
    parts = ["# Audit of case data", f"Dataset: `{report['dataset']}`", "## Summary", "\n".join(f"- {k}: {x}" for k, x in summary.items()), "## Findings"]
    for f in report["findings"]:
        parts += [f"### {f['severity'].upper()}: {f['finding']}", f["impact"], "Evidence: `" + json.dumps(f["evidence"], ensure_ascii=False, sort_keys=True) + "`"]
    return "\n\n".join(parts) + "\n"


def raw_features(rows: DataFrame, features: DataFrame) -> DataFrame:
    """The predictors of cases: categories, calendar terms, and the preceding month's flows where they apply."""
    fits = (F.col("study_sector") == "Postgraduate Research") & (F.col("submit_location") == "Outside Australia")
    joined = flows.lagged(rows, "lodged", features, fits)
    angle = F.month("lodged") * (2 * 3.141592653589793 / 12)
    return joined.withColumns({
        "lodgement_year": F.year("lodged").cast("double"), "lodgement_month_sin": F.sin(angle), "lodgement_month_cos": F.cos(angle), "official_flow_available": F.col("flow_available"),
        "official_lag1_lodged_log": F.log1p("lag1_lodged"), "official_lag1_granted_log": F.log1p("lag1_granted"), "official_lag1_net_per_100": F.col("lag1_net") / 100, "official_lag1_grant_lodged_ratio": F.col("lag1_grant_lodged_ratio"), "official_lag1_trailing_3m_lodged_log": F.log1p("lag1_trailing_3m_lodged")})


def load_flows(spark: SparkSession, path: str) -> DataFrame:
    """Features of the flows in a CSV file, or in the folder that ``refresh`` publishes to; none if there's neither."""
    published = f"{path}/current"
    rows = spark.read.parquet(published) if files.exists(spark, published) else files.read_csv(spark, path, FLOW_COLUMNS)
    rows = rows.withColumn("line_no", F.monotonically_increasing_id()).select("line_no", "activity_month", "activity_type", F.col("count").try_cast("double").alias("count"))
    return flows.flow_features(rows.where("`count` is not null"), "line_no")


def train(spark: SparkSession, cases: str, flow_path: str, output: str, cutoff: str = "2024-12-31", test_end: str = "2025-08-31", calibration_end: str = "2025-04-30", least: tuple[int, int, int] = (100, 50, 25)) -> dict:
    """Train the five models before the cutoff, rank and evaluate them after it, and write the artifact.

    Fewer rows than ``least`` to train, to test and in each test window are an error.
    """
    split = evaluate.time_split(observations(spark, cases), cutoff, test_end)
    rows = raw_features(split, load_flows(spark, flow_path))
    state = training.train_baselines(rows, CATEGORIES, NUMBERS, LEVELS, calibration_end, "record_id", least)
    digests = {n: files.file_digests(spark, p).orderBy("path").first()["sha256"] for n, p in (("case_dataset_sha256", cases), ("official_monthly_flows_sha256", flow_path)) if p.endswith(".csv") and files.exists(spark, p)}
    state = {"model_version": VERSION, "trained_at": datetime.now(ZoneInfo("UTC")).replace(microsecond=0).isoformat()} | digests | state
    files.write_artifact(spark, output, state)
    return state


def parse_instant(text: str, zone: str) -> datetime:
    found = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return found if found.tzinfo else found.replace(tzinfo=ZoneInfo(zone))


def forecast(spark: SparkSession, state: dict, requests: list[dict], flow_path: str, zone: str = "Asia/Shanghai") -> list[dict]:
    """Conditional dates and probabilities of requests (lodged_at, as_of, categories), kept to the minute in their own zone."""
    known, months = [], load_flows(spark, flow_path)
    for n, r in enumerate(requests):
        lodged, now = parse_instant(r["lodged_at"], zone), parse_instant(r["as_of"], zone)
        if now < lodged:
            raise ValueError("as_of must not be before lodged_at")
        known.append((n, lodged.date(), (now - lodged).total_seconds() / 86400, *[r.get(c, "unknown" if c in ("includes_partner", "is_diy") else "Unknown") for c in CATEGORIES]))
    frame = spark.createDataFrame(known, "n int, lodged date, elapsed double, " + ", ".join(f"{c} string" for c in CATEGORIES))
    encoder = models.FeatureEncoder.from_dict(state["feature_encoder"])
    rows = encoder.transform(raw_features(frame, months))
    found = rows.select("n", "elapsed", "flow_available", *CATEGORIES, *[c.alias(n) for n, c in models.weibull_columns(state["parameters"], F.col("elapsed")).items()]).orderBy("n").collect()
    out = []
    for r, row in zip(requests, found):
        lodged = parse_instant(r["lodged_at"], zone)
        missing = row.study_sector == "Postgraduate Research" and row.submit_location == "Outside Australia" and not row.flow_available
        warnings = ["no flow of the month before"] * bool(missing) + [f"unseen {c}: {row[c]}" for c in CATEGORIES if row[c] not in encoder.levels[c]]
        score = max(0, state["confidence"]["score"] - 5 * len(warnings))
        out.append({
            "dates": {p: (lodged + timedelta(days=row[p])).isoformat(timespec="minutes") for p in ("p10", "p50", "p80", "p90")}, "remaining_days": {p: round(max(0.0, row[p] - row.elapsed), 1) for p in ("p10", "p50", "p80", "p90")},
            "probabilities": {f"within_{d}_days": round(row[f"within_{d}"], 4) for d in (30, 60, 90, 180)}, "confidence": score, "grade": grade_of(score), "warnings": warnings})
    return out


def refresh(spark: SparkSession, current: DataFrame, folder: str, detected_at: str, first: str, last: str) -> int:
    """Publish a new vintage of flows: checked, compared with the one before, logged; returns its revisions.

    Everything is computed before anything is written; any issue, such as an empty table, stops the run.
    Columns of the lineage that ``current`` lacks are null.
    """
    given = [F.col(f"`{c}`") if c in current.columns else F.lit(None).cast("string").alias(c) for c in FLOW_COLUMNS]
    current = current.select(*given).orderBy("activity_month", "activity_type").cache()
    wrong = flows.validation_issues(current, first, last).limit(10).collect()
    if wrong:
        raise ValueError(f"flows are not valid: {[tuple(r) for r in wrong]}")
    changed = 0
    if files.exists(spark, f"{folder}/current"):
        found = flows.revision_log(current, spark.read.parquet(f"{folder}/current"), detected_at)
        found = spark.createDataFrame(found.collect(), found.schema)  # one row a month and type at most
        changed = found.count()
        files.append(found, f"{folder}/revisions")
    current.coalesce(1).write.mode("overwrite").parquet(f"{folder}/current.part")  # a row a month and type, in their order
    fixed = spark.read.parquet(f"{folder}/current.part")
    files.write_vintage(fixed, f"{folder}/snapshots")
    fixed.coalesce(1).write.mode("overwrite").parquet(f"{folder}/current")
    current.unpersist()
    return changed
