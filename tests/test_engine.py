from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwell.functions import rules
from dwell.functions.records import RAW, normalize_cases
from dwell.functions.social import meta_of, normalize_posts, timeline_of
from dwell.operators import evaluate, flows, models, quality, survival
from dwell.plans import jobs
from dwell.sources import files, web


def raw(spark, **cells):
    return spark.createDataFrame([tuple(cells.get(n) for n in RAW)], ", ".join(f"`{n}` string" for n in RAW))


def test_granted_record(spark):
    row = normalize_cases(raw(spark, _id="abc123", submitTime="2026-01-01", getVisaTime="2026-01-21", ifGetVisa="true", educationLevel="博士", submitPlace="国内递交", ifIncludedCouple="单独学签", ifDIY="true", major="计算机科学", schoolType="Monash"), "2026-09-24").first()
    assert (row.waiting_days, row.event_observed, row.education_level, row.field_of_study_group, row.provider_group, row.quality_flags, row.record_quality_score) == (20, 1, "PhD", "Computing and Data", "Group of Eight", "", 100)
    assert (row.includes_partner, row.is_diy, row.submit_location) == ("no", "yes", "Outside Australia")


def test_pending_and_dirty_records(spark):
    row = normalize_cases(raw(spark, _id="pending", submitTime="2026-09-01", ifGetVisa="false"), "2026-09-24").first()
    assert (row.waiting_days, row.event_observed, row.application_status) == (23, 0, "pending")
    row = normalize_cases(raw(spark, _id="x", submitTime="2026-01-05", ifGetVisa="是", educationLevel="phd", submitPlace="inside"), "2026-09-24").first()
    assert (row.application_status, row.quality_flags, row.record_quality_score) == ("pending", "granted_without_decision_date", 70)
    row = normalize_cases(raw(spark, _id="x", submitTime="2026-01-05", getVisaTime="2026-01-01", ifGetVisa="yes", educationLevel="phd", submitPlace="inside"), "2026-09-24").first()
    assert (row.waiting_days, row.record_quality_score, row.quality_flags) == (-4, 0, "decision_before_lodgement|implausible_waiting_days")
    import hashlib
    import json

    cells = {"submitTime": "2026-1-5", "major": 'a "q"\té'}
    row = normalize_cases(raw(spark, **cells), "2026-09-24").first()
    text = json.dumps({n: cells.get(n) for n in RAW}, sort_keys=True, ensure_ascii=False)
    assert row.lodgement_date is None and row.record_id == "VD-" + hashlib.sha256(text.encode()).hexdigest()[:20]


def points(spark, *rows):
    return spark.createDataFrame([(float(d), e) for d, e in rows], "days double, event int")


def test_curves(spark):
    a = survival.km_curve(points(spark, (5, 1), (8, 0), (10, 1), (20, 1)))
    assert {r.days: r.survival for r in a.collect()} == {0.0: 1.0, 5.0: 0.75, 10.0: 0.375, 20.0: 0.0}
    assert tuple(survival.crossings(a).first()) == (5.0, 10.0, 20.0)
    b = survival.crossings(survival.km_curve(points(spark, (5, 1), (10, 0), (20, 1), (30, 1)))).first()
    assert tuple(b) == (5.0, 20.0, 30.0)
    at = {r.horizon: r.survival for r in survival.survival_at(a, [1, 5, 19, 99]).collect()}
    assert at == {1.0: 1.0, 5.0: 0.75, 19.0: 0.375, 99.0: 0.0}
    assert spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "w double").agg(survival.effective_size(F.col("w"))).first()[0] == pytest.approx(16 / 6)


def test_time_split_censors_at_the_cutoff(spark):
    rows = spark.createDataFrame([(date(2024, 7, 1), date(2025, 8, 15), 1, 410)], "lodged date, decided date, event int, days int")
    row = evaluate.time_split(rows, "2024-12-31", "2025-08-31").first()
    assert (row.split, row.observed, row.duration) == ("train", 0, 183.0)


def test_fiscal_months_and_platforms(spark):
    rows = spark.createDataFrame([("2025-26", m) for m in (1, 6, 7, 12)], "fy string, m int")
    assert [r[0] for r in rows.select(rules.calendar_month(F.col("fy"), F.col("m"))).collect()] == ["2025-07", "2025-12", "2026-01", "2026-06"]
    urls = {"https://www.xiaohongshu.com/a": "Xiaohongshu", "https://m.weibo.cn": "Weibo", "https://x.com/i": "X", "https://netflix.com": "X", "https://old.reddit.com/r": "Reddit", "ftp://a.b/x.com": "PublicWeb", None: "PublicWeb"}
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", rules.platform(F.col("u"))).collect()
    assert {r[0]: r[1] for r in got} == urls


def test_flows(spark):
    rows = spark.createDataFrame([(f"2020-{m:02d}", "lodged", m) for m in (1, 2, 5, 6)], "activity_month string, activity_type string, count long")
    got = {r.activity_month: r.trailing_3m_lodged for r in flows.flow_features(rows).collect()}
    assert got == {"2020-01": 1.0, "2020-02": 3.0, "2020-05": 5.0, "2020-06": 11.0}
    prior = rows.where("activity_month = '2020-05'").withColumn("count", F.lit(3))
    assert [(r.activity_month, r.difference) for r in flows.revisions(rows, prior).collect()] == [("2020-05", 2)]
    grid = spark.createDataFrame([(f"{y}-{m:02d}", t, 1) for y in range(2015, 2027) for m in range(1, 13) for t in ("lodged", "granted") if (y, m) <= (2026, 8)], rows.schema)
    assert grid.count() == 280 and flows.grain_issues(grid, "2015-01", "2026-08").count() == 0
    assert {r.issue for r in flows.grain_issues(grid.union(grid.limit(1)).where("activity_month < '2026-01'"), "2015-01", "2026-08").collect()} == {"duplicate_grain", "coverage"}


def test_dedup_ties(spark):
    rows = spark.createDataFrame([(1, "k", 50), (2, "k", 50), (3, "k", 60), (4, "", 1), (5, "", 1)], "n int, key string, q int")
    assert {r.n for r in quality.best_quality(rows.where("n < 3"), "key", "q", "n").collect()} == {1}
    assert {r.n for r in quality.best_quality(rows.where("key <> ''"), "key", "q", "n").collect()} == {3}
    assert {r.n for r in quality.first_seen(rows, "key", "n").collect()} == {1, 4, 5}


def test_concordance_and_calibration(spark):
    rows = spark.createDataFrame([(1.0, 1, 3.0), (2.0, 1, 2.0), (3.0, 1, 2.0)], "d double, e int, r double")
    got = evaluate.concordance(rows, "d", "e", "r").first()
    assert got.comparable_pairs == 3 and got.harrell_c_index == pytest.approx(2.5 / 3)
    pairs = spark.createDataFrame([(0.1, 0.0), (0.2, 1.0), (0.3, 0.0), (0.6, 1.0)], "p double, y double")
    knots = models.calibration_knots(pairs, "p", "y")
    assert np.allclose(knots, [(0, 0), (0.1, 0), (0.25, 0.5), (0.6, 1), (1, 1)])
    ask = spark.createDataFrame([(0.0,), (0.175,), (0.9,)], "p double")
    assert np.allclose([r[0] for r in ask.select(models.interpolate(F.col("p"), knots)).collect()], [0, 0.25, 1])


def test_models_recover_a_known_process(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, 3000).astype(float)
    t = np.exp(4 + 0.8 * x) * rng.weibull(1.5, 3000)
    stop = rng.exponential(150, 3000)
    rows = [([float(a)], float(max(0.5, min(b, c))), int(b <= c)) for a, b, c in zip(x, t, stop)]
    frame = spark.createDataFrame(rows, "x array<double>, duration double, observed int").repartition(3).cache()
    theta = models.fit_weibull(frame, 1, ridge=0.0, shape_ridge=0.0)
    assert np.allclose(theta, [4, 0.8, np.log(1.5)], atol=0.12)
    stock = models.fit_spark_aft(frame)
    assert np.allclose([stock.intercept, stock.coefficients[0], -np.log(stock.scale)], theta, atol=0.02)
    beta, hazard = models.fit_cox(frame.withColumn("duration", F.round("duration")), 1, ridge=0.0)
    assert beta[0] == pytest.approx(-0.8 * 1.5, abs=0.15)
    assert all(a[1] < b[1] for a, b in zip(hazard, hazard[1:]))
    trees = models.fit_forest(frame.withColumn("k", F.monotonically_increasing_id()), "k", trees=6)
    s = models.forest_survival(frame.limit(200), trees, [20.0, 60.0, 180.0]).collect()
    assert all(1 >= r.s_20 >= r.s_60 >= r.s_180 >= 0 for r in s)
    assert np.mean([r.s_60 for r in s if r.x[0]]) > np.mean([r.s_60 for r in s if not r.x[0]])
    q = models.lognormal_quantiles(spark.createDataFrame([(0.0, 30.0, 90.0), (50.0, 30.0, 90.0)], "e double, a double, b double"), "e", "a", "b").collect()
    assert q[0].q50 == pytest.approx(30) and q[0].q90 == pytest.approx(90) and 50 <= q[1].q10 < q[1].q50 < q[1].q90


def test_posts(spark):
    assert timeline_of("2026年3月2日递签，2026年4月15日下签，澳洲500博士") == (date(2026, 3, 2), date(2026, 4, 15), "high")
    assert timeline_of("2026-13-45 lodged") == (None, None, "none")
    posts = spark.createDataFrame([("X", "u", "PhD 国内递交，2026-03-02 lodged，2026-04-15 granted。username=someone", None), ("X", "v", "nothing", "")], "platform string, source_url string, text string, published_at string")
    rows = normalize_posts(posts, "2026-09-24").collect()
    assert len(rows) == 1 and (rows[0].waiting_days, rows[0].education_level, rows[0].record_quality_score, rows[0].requires_manual_review) == (44, "PhD", 75, "no")
    assert "someone" not in str(rows[0])
    page = '<meta property="og:title" content="A"><meta name="description" content="B"><script type="application/ld+json">{"c": 1}</script><meta property="article:published_time" content="t">'
    assert meta_of(page) == ('A B {"c": 1}', "t")


def test_pages_and_robots():
    pages = {1: {"data": [{"a": 1}, 5], "totalPages": 2}, 2: {"data": [{"a": 2}], "totalPages": 2}}
    assert list(web.numbered_pages(lambda u: pages[int(u.split("current%5D=")[1].split("&")[0])], "http://h")) == [{"a": 1}, {"a": 2}]
    with pytest.raises(web.CollectionError):
        list(web.numbered_pages(lambda u: {"data": 3}, "http://h"))
    chain = {"": {"data": [{"a": 1}], "meta": {"next_token": "n"}}, "n": {"data": [{"a": 2}]}}
    assert list(web.cursor_pages(lambda u: chain["n" if "next_token=n" in u else ""], "http://h", {})) == [{"a": 1}, {"a": 2}]

    def gone(req, timeout):
        from urllib.error import HTTPError

        raise HTTPError(req.full_url, gone.code, "", None, None)

    gone.code = 404
    assert web.Client(opener=gone).allowed("http://h/x")
    gone.code = 403
    assert not web.Client(opener=gone).allowed("http://h/x")


def test_pivot_workbook(spark, tmp_path):
    import zipfile

    from dwell.sources import pivots

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    fields = [("Financial Year of Visa Lodged", ["2025-26 to 31 August 2025"]), ("Month", ["M01", "M02"]), ("Sector", ["S", "T"]), ("Total", [])]
    body = "".join(f'<cacheField name="{n}"><sharedItems>' + "".join(f'<s v="{x}"/>' for x in some) + "</sharedItems></cacheField>" for n, some in fields)
    records = "".join(f'<r><x v="0"/><x v="{m}"/><x v="{s}"/><n v="{t}"/></r>' for m, s, t in ((0, 0, 2), (0, 0, 3.7), (1, 0, 4), (1, 1, 9)))
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/pivotCache/pivotCacheDefinition1.xml", f"<d {space}><cacheFields>{body}</cacheFields></d>")
        z.writestr("xl/pivotCache/pivotCacheRecords1.xml", f"<d {space}>{records}</d>")
    cells = pivots.read_pivots(spark, str(tmp_path), {"Sector": "S"})
    assert {r[0]: r[1] for r in pivots.monthly_totals(cells).collect()} == {"2025-07": 5, "2025-08": 4}
    assert cells.agg(pivots.snapshot_date(F.col("fiscal_year"), F.lit("x"))).first()[0] == date(2025, 8, 31)


def test_files_and_jobs(spark, tmp_path):
    assert files.read_csv(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0
    rows = ["﻿" + ",".join(jobs.CASE_COLUMNS)]
    rng = np.random.default_rng(2)
    for i in range(260):
        lodged = date(2024, 1, 1).toordinal() + int(rng.integers(0, 600))
        event = int(rng.random() < 0.8)
        wait = int(rng.integers(5, 90))
        end = date.fromordinal(lodged + wait).isoformat()
        rows.append(",".join(map(str, (f"r{i}", f"d{i // 2 if i < 20 else i}", "s", "C", end, 500, "granted" if event else "pending", event, date.fromordinal(lodged).isoformat(), end if event else "", end, wait, "PhD" if i % 2 else "Master", "Postgraduate Research", "Other", "Outside Australia", "no", "yes", "Unknown", 80, "", "u"))))
    path = str(tmp_path / "cases.csv")
    (tmp_path / "cases.csv").write_text("\n".join(rows), encoding="utf-8")
    assert jobs.validate(spark, path) == {"rows": 260, "missing_ids": 0, "usable": 260, "duplicate_ids": 0, "missing_columns": []}
    report = jobs.audit(spark, path)
    assert report["uniqueness"]["duplicate_timeline_groups"] == 10 and report["uniqueness"]["rows_after_quality_and_dedup"] == 250
    got = jobs.predict(spark, path, education="PhD", runs=20)
    assert got["p10_days"] <= got["median_days"] <= got["p90_days"] and got["confidence_grade"] == "C"
    state = jobs.train(spark, path, str(tmp_path / "noflows.csv"), str(tmp_path / "model.json"))
    assert files.read_artifact(spark, str(tmp_path / "model.json"))["engine"] == "weibull_aft"
    ask = {"lodged_at": "2026-08-20T10:17+08:00", "as_of": "2026-09-24T10:17+08:00", "education_level": "PhD", "study_sector": "Postgraduate Research", "submit_location": "Outside Australia"}
    found = jobs.forecast(spark, state, [ask], str(tmp_path / "noflows.csv"))[0]
    assert found["dates"]["p50"].endswith("+08:00") and found["dates"]["p10"] <= found["dates"]["p50"] <= found["dates"]["p90"]
    with pytest.raises(ValueError):
        jobs.forecast(spark, state, [ask | {"as_of": "2020-01-01"}], str(tmp_path / "noflows.csv"))
    assert jobs.confidence(1076, 0.531, 0.2105, 0.7778) == 33
    table = str(tmp_path / "table")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.upsert_table(one, table, ["k"])
    assert sorted(map(tuple, files.upsert_table(spark.createDataFrame([(2, "c"), (3, "d")], one.schema), table, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    flow = spark.createDataFrame([("2020-01-31", "2020-01", t, 5) for t in ("lodged", "granted")], "source_snapshot_date string, activity_month string, activity_type string, count long")
    assert jobs.refresh(spark, flow, str(tmp_path / "flows"), "now", "2020-01", "2020-01") == 0
    assert jobs.refresh(spark, flow.withColumn("count", F.lit(6).cast("long")), str(tmp_path / "flows"), "now", "2020-01", "2020-01") == 2
    with pytest.raises(ValueError):
        jobs.refresh(spark, flow.limit(1), str(tmp_path / "flows"), "now", "2020-01", "2020-01")


def test_streamed_dedup(spark, tmp_path):
    from dwell.streaming import events

    rows = spark.sql("select 1L event_id, timestamp'2024-01-01 00:00:00' ts, 'a' event_type, 1.5d value union all select 1L, timestamp'2024-01-01 01:00:00', 'a', 2d union all select 2L, timestamp'2024-01-01 02:00:00', 'b', 1d")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    kept = events.first_by_id(events.open_stream(spark, str(tmp_path)))
    run = kept.writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r.event_id for r in spark.table("kept").collect()) == [1, 2]
