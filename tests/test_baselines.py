import io
import json
import random
from datetime import date, datetime, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dwell import cli
from dwell.operators import evaluate, flows, predictors, quality
from dwell.plans import anchors, charts, jobs, training
from dwell.sources import web


def test_evaluation_matches_pairs_of_rows(spark):
    rng = random.Random(1)
    rows = [(float(rng.randrange(1, 40)), rng.randrange(2), float(rng.randrange(6))) for _ in range(120)]
    scored = spark.createDataFrame([(*r, 5.0, 12.0, None if k % 5 else 30.0, 0.8, 0.5, 0.1) for k, r in enumerate(rows)], "duration double, observed int, risk double, p10 double, p50 double, p90 double, s_90 double, s_180 double, s_365 double")
    got = evaluate.evaluate_model(scored, "m").first()
    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0] and a[1]]
    won = sum(1.0 if a[2] > b[2] else 0.5 if a[2] == b[2] else 0.0 for a, b in pairs)
    assert got.comparable_pairs == len(pairs) and got.harrell_c_index == pytest.approx(won / len(pairs), abs=1e-4)
    assert (got.test_rows, got.test_events) == (120, sum(r[1] for r in rows))
    assert got.event_only_interval_rows == sum(r[1] for k, r in enumerate(rows) if k % 5 == 0)
    none = evaluate.evaluate_model(scored.limit(0), "m").first()
    assert none.test_rows == 0 and none.harrell_c_index is None and none.brier_90 is None


def test_strata_fall_back_and_calibration_needs_pairs(spark):
    rows = [("a", "x", float(d), 1) for d in range(1, 61)] + [("a", "y", 5.0, 1)] * 3 + [("b", "z", 100.0, 1)] * 2
    train = spark.createDataFrame(rows, "f string, g string, duration double, observed int")
    tables = predictors.fit_strata(train, [["f", "g"], ["f"], []])
    asked = spark.createDataFrame([("a", "x"), ("a", "q"), ("b", "z"), (None, "x")], "f string, g string")
    got = {(r.f, r.g): (r.level, r.p50) for r in predictors.predict_strata(asked, tables).collect()}
    assert got[("a", "x")] == (0, 30.0) and got[("a", "q")][0] == 1 and got[("b", "z")][0] == got[(None, "x")][0] == 2
    few = predictors.predict_strata(train, tables).limit(5)
    assert predictors.fit_calibrator(few) == [(0.0, 0.0), (1.0, 1.0)]
    # a row censored before a horizon says nothing of it
    one = spark.createDataFrame([(100.0, 0, 0.9, 0.8, 0.7), (100.0, 1, 0.9, 0.8, 0.7)], "duration double, observed int, s_90 double, s_180 double, s_365 double")
    assert sorted(map(tuple, predictors.calibration_pairs(one).collect())) == [(pytest.approx(0.1), 0.0), (pytest.approx(0.1), 0.0), (pytest.approx(0.2), 1.0), (pytest.approx(0.3), 1.0)]
    assert predictors.inverse([(0.0, 0.0), (0.5, 0.2), (1.0, 1.0)], 0.6) == pytest.approx(0.75)


def test_forest_and_cox_predictions(spark):
    rows = spark.createDataFrame([([0.0],), ([1.0],)], "x array<double>")
    trees = [{"feature": 0, "cut": 0.5, "left": {"curve": [[0.0, 1.0], [10.0, 0.5], [20.0, 0.0]]}, "right": {"curve": [[0.0, 1.0], [100.0, 0.8]]}}]
    got = sorted(predictors.predict_forest(rows, trees).collect(), key=lambda r: r.x)
    assert (got[0].p10, got[0].p50, got[0].p90, got[0].risk) == (10.0, 10.0, 20.0, -10.0)
    assert (got[1].p10, got[1].p50, got[1].s_90, got[1].s_180, got[1].risk) == (100.0, None, 1.0, 0.8, -predictors.NEVER)
    cox = predictors.predict_cox(rows, predictors.linear([1.0]), [(50.0, 0.2), (150.0, 1.0)])
    cox = {r.x[0]: r for r in cox.collect()}
    assert (cox[0.0].p10, cox[0.0].p50, cox[0.0].p90) == (50.0, 150.0, None) and cox[1.0].risk == 1.0
    assert cox[0.0].s_90 == pytest.approx(0.8187308) and training.grade_of(54) == "limited"


def test_ranking_puts_missing_concordance_last(spark):
    found = spark.createDataFrame([("a", None, 0.1), ("b", 0.6, 0.3), ("c", 0.6, 0.2)], "model string, harrell_c_index double, brier_180 double")
    assert [r.model for r in training.rank_models(found).orderBy("place").collect()] == ["c", "b", "a"]


def observations(spark, n=60):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        day = date(2025, 1, 1 + i % 28)
        rows.append((i, float(rng.randrange(20, 90)), int(i % 4 > 0), day, day, day, 80, "B", "PhD" if i % 2 else "Master", "Postgraduate Research", "Outside Australia"))
    return spark.createDataFrame(rows, "line_no long, days double, event int, lodged date, decided date, as_of date, quality int, source_quality_tier string, education_level string, study_sector string, submit_location string")


def test_anchor_forecast(spark, tmp_path):
    path = str(tmp_path / "anchors.csv")
    (tmp_path / "anchors.csv").write_text("stream,percentile_50_days,percentile_90_days\nPostgraduate Research Sector,30,80\nPostgraduate Research Sector,60,200\nOther,,9\n")
    table = anchors.load_anchors(spark, path)
    assert [(r.stream, r.p50, r.p90) for r in table.collect()] == [("Postgraduate Research Sector", 60.0, 200.0)]
    cases = observations(spark)
    at = lambda d: datetime(2026, 1, d, tzinfo=timezone.utc)
    ask = {"study_sector": "Postgraduate Research", "education_level": "PhD", "submit_location": "any"}
    found = anchors.forecast(spark, cases, table, at(9), at(1), ask, {"evaluations": [{"model": "a"}, {"model": "b"}], "selected_baseline": "b"})
    assert found["as_of"] == found["lodged_at"] and found["elapsed_days"] == 0 and found["backtest"]["selected_evaluation"] == {"model": "b"}
    assert found["crowd_adjustment"]["target_rows"] == 30 and 0.5 <= found["crowd_adjustment"]["raw_crowd_ratio"] <= 2
    assert found["data_confidence"]["score"] == min(80, sum(found["data_confidence"]["components"].values())) and found["data_confidence"]["grade"] in "BCD"
    low, high = found["median_parameter_uncertainty"].values()
    assert low <= high
    with pytest.raises(anchors.MissingAnchor):
        anchors.forecast(spark, cases, table, at(1), at(2), {"study_sector": "School"})
    with pytest.raises(PySparkException):
        anchors.with_anchor(spark.createDataFrame([("none",)], "s string"), table, F.col("s")).collect()
    weighted = anchors.weighted(cases, "2025-02-01")
    assert anchors.multiplier_interval(weighted.limit(19), 50.0) is None and anchors.multiplier_interval(weighted, None) is None
    state = anchors.train_anchor_model(spark, cases, table, str(tmp_path / "a.json"), "2025-01-15")
    assert state["training_rows_after_quality_and_dedup"] == 60 and json.loads((tmp_path / "a.json").read_text())["official_anchors"]


def test_flows_round_trip_and_checks(spark, tmp_path):
    schema = "source_snapshot_date string, activity_month string, activity_type string, count long, source_file_sha256 string"
    flow = spark.createDataFrame([("2020-02-29", m, t, 5 + k, "s") for k, m in enumerate(("2020-01", "2020-02")) for t in ("lodged", "granted")], schema)
    folder = str(tmp_path / "flows")
    assert jobs.refresh(spark, flow, folder, "now", "2020-01", "2020-02") == 0
    got = {r.activity_month: (r.lodged, r.trailing_3m_lodged) for r in jobs.load_flows(spark, folder).collect()}
    assert got == {"2020-01": (5.0, 5.0), "2020-02": (6.0, 11.0)}
    assert jobs.refresh(spark, flow.withColumn("count", F.col("count") + (F.col("activity_type") == "lodged").cast("long")), folder, "later", "2020-01", "2020-02") == 2
    log = spark.read.parquet(folder + "/revisions").first()
    assert (log.difference, log.prior_source_sha256, log.new_snapshot_date) == (1, "s", "2020-02-29")
    for wrong in (flow.limit(0), flow.where("activity_type = 'lodged'")):
        assert "missing_activity_type" in {r.issue for r in flows.validation_issues(wrong, "2020-01", "2020-02").collect()}
        with pytest.raises(ValueError):
            jobs.refresh(spark, wrong, folder, "now", "2020-01", "2020-02")
    prior = spark.createDataFrame([("2020-01", "lodged", 9, 0), ("2020-01", "lodged", 5, 1)], "activity_month string, activity_type string, count long, n int")
    assert flows.revisions(flow, prior, "n").count() == 0


def test_audit_uses_both_dates_and_skips_rows_without_numbers(spark, tmp_path):
    header = jobs.CASE_COLUMNS
    base = {"record_id": "a", "duplicate_key": "d", "snapshot_date": "2025-06-01", "as_of_date": "2025-01-05", "decision_date": "2025-01-05", "lodgement_date": "2025-01-10", "waiting_days": "5", "event_observed": "1", "application_status": "granted", "record_quality_score": "80", "education_level": "PhD"}
    blank = base | {"record_id": "b", "duplicate_key": "e", "waiting_days": "x", "education_level": ""}
    half = base | {"record_id": "c", "duplicate_key": "f", "waiting_days": "12.5", "as_of_date": "2025-01-22", "decision_date": "2025-01-22"}
    path = tmp_path / "cases.csv"
    path.write_text("\n".join([",".join(header)] + [",".join(r.get(c, "") for c in header) for r in (base, blank, half)]))
    report = jobs.audit(spark, str(path))
    wrong = report["validity_issue_counts"]
    assert wrong["decision_before_lodgement"] == 1 and "future_lodgement" not in wrong and wrong["invalid_numeric_field"] == 2
    assert report["predictor_unknown_rates"]["education_level"] == 0.0 and report["predictor_unknown_rates"]["is_diy"] == pytest.approx(0.3333)
    assert report["findings"][0]["severity"] == "critical" and "## Findings" in jobs.audit_markdown(report)
    assert [r.days for r in jobs.observations(spark, str(path)).where("record_id = 'c'").collect()] == [12.5]
    volume = charts.case_volume(spark.read.csv(str(path), header=True))
    assert [tuple(r) for r in volume.collect()] == [("2025-01", 3, 3)]


def test_package_resources_and_downloads(spark, tmp_path):
    item = lambda name, kind="xlsx": {"id": name[-1], "name": name, "url": "u", "last_modified": "m", "format": kind}
    both = [item("Student Visas Lodged Report 1"), item("student visas lodged report 2"), item("Student visas granted report 3"), item("Student visas granted report 4", "PDF")]
    found = web.package_resources(lambda url: {"success": True, "result": {"resources": both}}, "p")
    assert {k: r["resource_id"] for k, r in found.items()} == {"lodged": "2", "granted": "3"}
    for bad in ({"success": False}, {"success": True, "result": {"resources": both[:2]}}):
        with pytest.raises(web.CollectionError):
            web.package_resources(lambda url, bad=bad: bad, "p")
    web.download(spark, "http://x", str(tmp_path / "f"), opener=lambda r, timeout: io.BytesIO(b"abc" * 9), chunk=4)
    assert (tmp_path / "f").read_bytes() == b"abc" * 9


def test_commands_take_their_options():
    a = cli.parser().parse_args(["forecast", "--lodged-at", "2026-01-01", "--engine", "anchor", "--is-diy", "yes"])
    assert (a.engine, a.is_diy, a.education_level) == ("anchor", "yes", "PhD")
    assert cli.parser().parse_args(["social-collect", "x", "--output", "o", "--collected", "c"]).max_pages == 3


def test_first_rows_by_aggregate(spark):
    rows = spark.createDataFrame([("k", None, 1), ("k", 50, 3), ("k", 50, 2), (None, 1, 4), (None, 1, 5)], "key string, q int, n int")
    assert sorted(r.n for r in quality.best_quality(rows, "key", "q", "n").collect()) == [2, 4]
    assert sorted(r.n for r in quality.first_seen(rows, "key", "n").collect()) == [1, 4, 5]
