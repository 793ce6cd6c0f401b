"""Registered queries: audit, flows, evaluation, models, scoring, streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dwell.operators import evaluate, flows, models, quality, survival
from dwell.plans import views as v
from dwell.plans.catalog import _km_sql, longs, query, rounded
from dwell.sources.tables import read_table
from dwell.streaming import events as streams

# --- audit -------------------------------------------------------------------------------------------

_USABLE = "waiting BETWEEN 0 AND 3650 AND event IN (0, 1) AND quality >= 40"


@query(f"WITH {v.DIRTY_SQL} SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (record_id IS NULL)::BIGINT AS missing_id, (SELECT count(*) - count(DISTINCT record_id) FROM dirty)::BIGINT AS repeated_id, count(*) FILTER ({_USABLE})::BIGINT AS usable FROM dirty")
def validate_counts(spark, folder):
    rows = v.dirty_cases(spark, folder)
    ids = rows.groupBy("record_id").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_id"))
    counts = rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("record_id").isNull()).alias("missing_id"), F.count_if(quality.usable(rows)).alias("usable"))
    return counts.join(F.broadcast(ids)).select("n_rows", "missing_id", "repeated_id", "usable")  # one row each


_KINDS = {
    "missing_or_invalid_lodgement_date": "lodged IS NULL", "invalid_numeric_field": "NOT ok", "invalid_event_observed": "ok AND event NOT IN (0, 1)", "implausible_waiting_days": "ok AND NOT waiting BETWEEN 0 AND 3650",
    "future_lodgement": "ok AND lodged > snapshot", "decision_before_lodgement": "ok AND decided < lodged", "event_without_decision_date": "ok AND event = 1 AND decided IS NULL", "censored_with_decision_date": "ok AND event = 0 AND decided IS NOT NULL",
    "waiting_days_mismatch": "ok AND waiting <> CASE WHEN event = 1 THEN decided ELSE snapshot END - lodged", "status_event_mismatch": "ok AND status <> CASE WHEN event = 1 THEN 'granted' ELSE 'pending' END",
}


@query(f"WITH {v.DIRTY_SQL}, x AS (SELECT *, event IS NOT NULL AND waiting IS NOT NULL AND quality IS NOT NULL AS ok FROM dirty), c AS (" + " UNION ALL ".join(f"SELECT '{k}' AS issue, count(*) FILTER ({c})::BIGINT AS \"rows\" FROM x" for k, c in _KINDS.items()) + ') SELECT * FROM c WHERE "rows" > 0')
def audit_issue_counts(spark, folder):
    return quality.issues(v.dirty_cases(spark, folder))


@query(f"WITH {v.DIRTY_SQL} SELECT 'mode' AS field, round(avg((lower(trim(coalesce(mode, ''))) IN ('', 'unknown', '(blank)'))::INT), 4) AS rate FROM dirty UNION ALL SELECT 'band', round(avg((lower(trim(coalesce(band, ''))) IN ('', 'unknown', '(blank)'))::INT), 4) FROM dirty")
def unknown_rates(spark, folder):
    return quality.unknown_rates(v.dirty_cases(spark, folder), ["mode", "band"])


@query(f"WITH {v.CASES} SELECT year(lodged)::BIGINT AS lodged_year, count(*)::BIGINT AS cases FROM cases GROUP BY 1")
def lodgement_years(spark, folder):
    return v.cases(spark, folder, people=False).groupBy(F.year("lodged").cast("long").alias("lodged_year")).agg(F.count("*").alias("cases"))


@query(f"WITH {v.CASES} SELECT case_id, dup, quality::BIGINT AS quality FROM cases WHERE quality >= 40 QUALIFY row_number() OVER (PARTITION BY dup ORDER BY quality DESC, case_id) = 1")
def dedup_best_quality(spark, folder):
    return longs(quality.best_quality(v.cases(spark, folder).where("quality >= 40"), "dup", "quality", "case_id").select("case_id", "dup", "quality"), "quality")


@query(f"WITH {v.CASES} SELECT case_id, dup FROM cases QUALIFY row_number() OVER (PARTITION BY dup ORDER BY case_id) = 1")
def dedup_first_seen(spark, folder):
    return quality.first_seen(v.cases(spark, folder), "dup", "case_id").select("case_id", "dup")


@query(f"WITH {v.DIRTY_SQL} SELECT record_id, lodged, decided, waiting::BIGINT AS waiting, count(*)::BIGINT AS n FROM dirty GROUP BY ALL HAVING count(*) > 1")
def exact_duplicates(spark, folder):
    return v.dirty_cases(spark, folder).groupBy("record_id", "lodged", "decided", F.col("waiting").cast("long").alias("waiting")).agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {v.CASES}, g AS (SELECT dup, count(*) AS n FROM cases GROUP BY 1) SELECT count(*) FILTER (n > 1)::BIGINT AS groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_in_groups FROM g")
def duplicate_groups(spark, folder):
    return longs(quality.duplicate_counts(v.cases(spark, folder), "dup"), "groups", "rows_in_groups")


_SPLIT = f"""split AS (SELECT *, CASE WHEN lodged <= DATE '{v.CUTOFF}' THEN 'train' ELSE 'test' END AS split,
  greatest(0.5::DOUBLE, CASE WHEN lodged > DATE '{v.CUTOFF}' THEN days WHEN event = 1 AND decided <= DATE '{v.CUTOFF}' THEN decided - lodged ELSE DATE '{v.CUTOFF}' - lodged END) AS duration,
  CASE WHEN lodged > DATE '{v.CUTOFF}' THEN event WHEN event = 1 AND decided <= DATE '{v.CUTOFF}' THEN 1 ELSE 0 END AS observed FROM cases WHERE lodged <= DATE '{v.TEST_END}')"""


def _split(spark, folder, people=True):
    return evaluate.time_split(v.cases(spark, folder, people), v.CUTOFF, v.TEST_END)


@query(f"WITH {v.CASES}, {_SPLIT} SELECT case_id, split, duration, observed::BIGINT AS observed FROM split")
def time_split(spark, folder):
    return longs(_split(spark, folder, False).select("case_id", "split", "duration", "observed"), "observed")


@query(f"WITH {v.CASES}, {_SPLIT} SELECT CASE WHEN split = 'train' THEN split WHEN lodged <= DATE '{v.CALIBRATION_END}' THEN 'calibration' ELSE 'holdout' END AS part, count(*)::BIGINT AS cases, sum(observed)::BIGINT AS events FROM split GROUP BY 1")
def split_counts(spark, folder):
    part = F.when(F.col("split") == "train", "train").when(F.col("lodged") <= F.lit(v.CALIBRATION_END).cast("date"), "calibration").otherwise("holdout")
    return _split(spark, folder, False).groupBy(part.alias("part")).agg(F.count("*").alias("cases"), F.sum("observed").alias("events"))


# --- flows -------------------------------------------------------------------------------------------

_F = v.flows_sql("f")
_FEATURES = f"""{_F}, w AS (SELECT activity_month, coalesce(max("count") FILTER (activity_type = 'lodged'), 0)::DOUBLE AS lodged, coalesce(max("count") FILTER (activity_type = 'granted'), 0)::DOUBLE AS granted,
  substr(activity_month, 1, 4)::INT * 12 + substr(activity_month, 6, 2)::INT AS m FROM f GROUP BY 1),
ff AS (SELECT activity_month, lodged, granted, lodged - granted AS net, CASE WHEN lodged <> 0 THEN granted / lodged ELSE 0 END AS grant_lodged_ratio, sum(lodged) OVER (ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW) AS trailing_3m_lodged, m FROM w)"""


@query(f'WITH {v.CASES}, {_F} SELECT activity_month, activity_type, "count"::BIGINT AS "count" FROM f')
def monthly_flow(spark, folder):
    return v.monthly_flows(spark, folder)


@query(f"WITH {v.CASES}, {_FEATURES} SELECT activity_month, lodged, granted, net, round(grant_lodged_ratio, 6) AS grant_lodged_ratio, trailing_3m_lodged FROM ff")
def flow_features(spark, folder):
    return rounded(flows.flow_features(v.monthly_flows(spark, folder)), "grant_lodged_ratio")


@query(f"WITH {v.CASES}, {_FEATURES} SELECT case_id, coalesce(ff.lodged, 0) AS lag1_lodged, coalesce(ff.granted, 0) AS lag1_granted, (ff.m IS NOT NULL)::INT::DOUBLE AS flow_available, round(ln(1 + coalesce(trailing_3m_lodged, 0)), 6) AS trailing_log FROM cases LEFT JOIN ff ON ff.m = year(cases.lodged) * 12 + month(cases.lodged) - 1 AND segment IN ('BUILDING', 'MACHINERY')")
def flow_lag_join(spark, folder):
    joined = flows.lagged(v.cases(spark, folder).select("case_id", "lodged", "segment"), "lodged", flows.flow_features(v.monthly_flows(spark, folder)), F.col("segment").isin("BUILDING", "MACHINERY"))
    return joined.select("case_id", "lag1_lodged", "lag1_granted", "flow_available", F.round(F.log1p("lag1_trailing_3m_lodged"), 6).alias("trailing_log"))


@query(f'WITH {v.CASES}, {v.flows_sql("cur")}, {v.flows_sql("old", "case_id % 10 <> 0")} SELECT activity_month, activity_type, cur."count"::BIGINT AS new_count, old."count"::BIGINT AS prior_count, (cur."count" - old."count")::BIGINT AS difference FROM cur JOIN old USING (activity_month, activity_type) WHERE cur."count" <> old."count"')
def flow_revisions(spark, folder):
    return flows.revisions(v.monthly_flows(spark, folder), v.monthly_flows(spark, folder, "case_id % 10 <> 0"))


@query(f"""WITH {v.CASES}, {_F} SELECT 'missing_type' AS issue, activity_month AS detail FROM f GROUP BY 2 HAVING count(DISTINCT activity_type) < 2
UNION ALL SELECT 'coverage', activity_type || ' ' || min(activity_month) || ' ' || max(activity_month) FROM f GROUP BY activity_type HAVING min(activity_month) <> '1995-02' OR max(activity_month) < '2001-08'
UNION ALL SELECT 'duplicate_grain', activity_month || '/' || activity_type FROM f GROUP BY activity_month, activity_type HAVING count(*) > 1""")
def flow_grain_issues(spark, folder):
    return flows.grain_issues(v.monthly_flows(spark, folder), "1995-02", "2001-08")


@query(f'WITH {v.CASES}, {v.flows_sql("cur", "case_id % 3 = 0")}, {v.flows_sql("old", "lodged < DATE \'1999-01-01\'")} SELECT activity_month, activity_type, "count"::BIGINT AS "count" FROM cur UNION ALL SELECT activity_month, activity_type, "count"::BIGINT FROM old ANTI JOIN cur USING (activity_month, activity_type)')
def flow_upsert(spark, folder):
    return flows.upsert(v.monthly_flows(spark, folder, "lodged < DATE '1999-01-01'"), v.monthly_flows(spark, folder, "case_id % 3 = 0"), ["activity_month", "activity_type"])


@query(f"""WITH {v.CASES}, {_F} SELECT activity_month, coalesce(sum("count") FILTER (activity_type = 'lodged'), 0)::BIGINT AS lodged, coalesce(sum("count") FILTER (activity_type = 'granted'), 0)::BIGINT AS granted FROM f GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
def monthly_volume_last30(spark, folder):
    return flows.monthly_volume(v.monthly_flows(spark, folder), 30)


@query(f"""WITH {v.CASES}, {_F} SELECT substr(activity_month, 1, 4) AS activity_year, coalesce(sum("count") FILTER (activity_type = 'lodged'), 0)::BIGINT AS lodged, coalesce(sum("count") FILTER (activity_type = 'granted'), 0)::BIGINT AS granted FROM f GROUP BY 1""")
def yearly_totals(spark, folder):
    return v.monthly_flows(spark, folder).groupBy(F.substring("activity_month", 1, 4).alias("activity_year")).pivot("activity_type", ["lodged", "granted"]).agg(F.sum("count")).na.fill(0)


@query(f"""WITH {v.CASES}, {_F}, y AS (SELECT activity_type, substr(activity_month, 1, 4) AS y, "count" AS c FROM f) SELECT activity_type, 'y' || y AS period, sum(c)::BIGINT AS value FROM y WHERE y BETWEEN '1996' AND '1999' GROUP BY 1, 2""")
def unpivot_periods(spark, folder):
    years = ["1996", "1997", "1998", "1999"]
    wide = v.monthly_flows(spark, folder).withColumn("y", F.concat(F.lit("y"), F.substring("activity_month", 1, 4))).groupBy("activity_type").pivot("y", [f"y{y}" for y in years]).agg(F.sum("count"))
    return wide.unpivot(["activity_type"], [f"y{y}" for y in years], "period", "value").where("value is not null")


# --- evaluation --------------------------------------------------------------------------------------

_TRAIN_KM = f"train AS (SELECT * FROM split WHERE split = 'train'), test AS (SELECT * FROM split WHERE split = 'test'), {_km_sql('train', by='segment', days='duration', event='observed')}"
_Q = "q AS (SELECT segment, min(days) FILTER (round(s, 12) <= round(1 - 0.1::DOUBLE, 12)) AS p10, min(days) FILTER (round(s, 12) <= round(1 - 0.5::DOUBLE, 12)) AS p50, min(days) FILTER (round(s, 12) <= round(1 - 0.9::DOUBLE, 12)) AS p90 FROM curve GROUP BY 1)"
_H = "h(horizon) AS (VALUES (90.0::DOUBLE), (180.0), (365.0)), sv AS (SELECT segment, horizon, coalesce(arg_max(s, days) FILTER (days <= horizon), 1.0) AS sv FROM curve, h GROUP BY 1, 2)"


def _train_curve(split):
    return survival.km_curve(split.where("split = 'train'"), ["segment"], days="duration", event="observed")


@query(f"WITH {v.CASES}, {_SPLIT}, {_TRAIN_KM}, {_Q}, t AS (SELECT duration, observed, -coalesce(p50, 1e9) AS risk FROM test JOIN q USING (segment)), c AS (SELECT duration, risk, count(*) AS n, sum(observed) AS e FROM t GROUP BY 1, 2) SELECT sum(a.e * b.n)::BIGINT AS comparable_pairs, round(sum(a.e * b.n * CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) / sum(a.e * b.n), 6) AS harrell_c_index FROM c a JOIN c b ON a.duration < b.duration AND a.e > 0")
def concordance_km(spark, folder):
    split = _split(spark, folder)
    q = survival.crossings(_train_curve(split), ["segment"])
    test = split.where("split = 'test'").join(F.broadcast(q), "segment").withColumn("risk", -F.coalesce("p50", F.lit(1e9)))
    return rounded(longs(evaluate.concordance(test, "duration", "observed", "risk"), "comparable_pairs"), "harrell_c_index")


_SCORES = f"WITH {v.CASES}, {_SPLIT}, {_TRAIN_KM}, {_H}, z AS (SELECT horizon, 1 - sv AS p, (observed = 1 AND duration <= horizon)::INT AS y FROM test JOIN sv USING (segment))"


def _horizons(spark, folder):
    split = _split(spark, folder)
    at = survival.survival_at(_train_curve(split), list(v.HORIZONS), ["segment"])
    return evaluate.horizon_scores(split.where("split = 'test'"), at, ["segment"])


@query(f"{_SCORES} SELECT horizon, round(avg((p - y) * (p - y)), 6) AS brier FROM z GROUP BY 1")
def brier_by_horizon(spark, folder):
    return rounded(_horizons(spark, folder).select("horizon", "brier"), "brier")


@query(f"{_SCORES} SELECT horizon, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS observed_fraction, round(avg(p) - avg(y), 6) AS calibration_gap FROM z GROUP BY 1")
def calibration_gap(spark, folder):
    return rounded(_horizons(spark, folder).drop("brier"), "mean_predicted", "observed_fraction", "calibration_gap")


@query(f"WITH {v.CASES}, {_SPLIT}, {_TRAIN_KM}, {_Q} SELECT median(abs(duration - p50))::DOUBLE AS median_absolute_error FROM test JOIN q USING (segment) WHERE observed = 1")
def median_abs_error(spark, folder):
    split = _split(spark, folder)
    return evaluate.interval_scores(split.where("split = 'test'").join(F.broadcast(survival.crossings(_train_curve(split), ["segment"])), "segment")).select("median_absolute_error")


@query(f"WITH {v.CASES}, {_SPLIT}, {_TRAIN_KM}, {_Q} SELECT round(avg((duration BETWEEN p10 AND p90)::INT) FILTER (p10 IS NOT NULL AND p90 IS NOT NULL), 6) AS coverage, count(*) FILTER (p10 IS NOT NULL AND p90 IS NOT NULL)::BIGINT AS interval_rows FROM test JOIN q USING (segment) WHERE observed = 1")
def interval_coverage(spark, folder):
    split = _split(spark, folder)
    scores = evaluate.interval_scores(split.where("split = 'test'").join(F.broadcast(survival.crossings(_train_curve(split), ["segment"])), "segment"))
    return rounded(scores.select("coverage", "interval_rows"), "coverage")


@query(f"""WITH {v.CASES}, u AS (SELECT CASE WHEN event = 1 AND decided <= DATE '{v.CUTOFF}' THEN days ELSE DATE '{v.CUTOFF}' - lodged END AS days, (event = 1 AND decided <= DATE '{v.CUTOFF}')::INT AS event, CASE WHEN event = 1 AND decided > DATE '{v.CUTOFF}' THEN days END AS actual FROM cases WHERE lodged <= DATE '{v.CUTOFF}'),
{_km_sql('u')}, q AS (SELECT min(days) FILTER (round(s, 12) <= round(1 - 0.1::DOUBLE, 12)) AS p10, min(days) FILTER (round(s, 12) <= round(1 - 0.5::DOUBLE, 12)) AS p50, min(days) FILTER (round(s, 12) <= round(1 - 0.9::DOUBLE, 12)) AS p90 FROM curve)
SELECT p10, p50, p90, count(actual)::BIGINT AS test_events, round(avg((actual BETWEEN p10 AND p90)::INT) FILTER (actual IS NOT NULL), 6) AS coverage FROM u, q GROUP BY 1, 2, 3""")
def retro_backtest(spark, folder):
    cut = F.lit(v.CUTOFF).cast("date")
    known = F.coalesce((F.col("event") == 1) & (F.col("decided") <= cut), F.lit(False))
    rows = v.cases(spark, folder, people=False).where(F.col("lodged") <= cut)
    train = rows.select(F.when(known, F.col("days")).otherwise(F.datediff(cut, "lodged")).alias("days"), known.cast("int").alias("event"))
    q = survival.crossings(survival.km_curve(train))
    late = rows.where((F.col("event") == 1) & (F.col("decided") > cut)).select("days").join(F.broadcast(q))  # one row
    scores = late.agg(F.count("*").alias("test_events"), F.avg(F.col("days").between(F.col("p10"), F.col("p90")).cast("double")).alias("coverage"))
    return rounded(q.join(F.broadcast(scores)).select("p10", "p50", "p90", "test_events", "coverage"), "coverage")


# --- models ------------------------------------------------------------------------------------------

_CATEGORIES, _NUMBERS = ["segment", "priority"], ["lodged_year", "month_sin", "month_cos"]


def _features(spark, folder):
    split = _split(spark, folder)
    angle = F.month("lodged") * (2 * math.pi / 12)
    return split.withColumns({"lodged_year": F.year("lodged").cast("double"), "month_sin": F.sin(angle), "month_cos": F.cos(angle)})


def _encoded(spark, folder):
    rows = _features(spark, folder)
    encoder = models.FeatureEncoder.fit(rows.where("split = 'train'"), _CATEGORIES, _NUMBERS)
    return encoder, encoder.transform(rows)


_ENCODE = f"""fx AS (SELECT *, year(lodged)::DOUBLE AS lodged_year, sin(month(lodged) * {2 * math.pi / 12!r}::DOUBLE) AS month_sin, cos(month(lodged) * {2 * math.pi / 12!r}::DOUBLE) AS month_cos FROM split),
st AS (SELECT avg(lodged_year) AS my, stddev_pop(lodged_year) AS sy, avg(month_sin) AS ms, stddev_pop(month_sin) AS ss, avg(month_cos) AS mc, stddev_pop(month_cos) AS sc FROM fx WHERE split = 'train')"""


@query(f"""WITH {v.CASES}, {_SPLIT}, {_ENCODE} SELECT case_id, (segment = 'BUILDING')::INT::DOUBLE AS segment_building, (segment = 'MACHINERY')::INT::DOUBLE AS segment_machinery, (priority = '3-MEDIUM')::INT::DOUBLE AS priority_medium,
round((lodged_year - my) / sy, 5) AS lodged_year, round((month_sin - ms) / ss, 5) AS month_sin, round((month_cos - mc) / sc, 5) AS month_cos FROM fx, st""")
def encode_features(spark, folder):
    rows = _features(spark, folder)
    columns = models.FeatureEncoder.fit(rows.where("split = 'train'"), _CATEGORIES, _NUMBERS).columns()
    return rows.select("case_id", columns["segment=BUILDING"].alias("segment_building"), columns["segment=MACHINERY"].alias("segment_machinery"), columns["priority=3-MEDIUM"].alias("priority_medium"), *[F.round(columns[n], 5).alias(n) for n in _NUMBERS])


@query()
def aft_quantiles(spark, folder):
    encoder, rows = _encoded(spark, folder)
    theta = models.fit_weibull(rows.where("split = 'train'"), len(encoder.names))
    cells = models.weibull_columns(theta, F.lit(0.0), ahead=(90, 180, 365), shares=(0.1, 0.5, 0.9))
    return rows.where("split = 'test'").select("case_id", "duration", "observed", *[c.alias(n) for n, c in cells.items()])


@query()
def cox_hazard(spark, folder):
    encoder, rows = _encoded(spark, folder)
    _, hazard = models.fit_cox(rows.where("split = 'train'"), len(encoder.names))
    return spark.createDataFrame(hazard, "days double, hazard double")


@query()
def rsf_survival(spark, folder):
    encoder, rows = _encoded(spark, folder)
    trees = models.fit_forest(rows.where("split = 'train'"), "case_id")
    return models.forest_survival(rows.where("split = 'test'").select("case_id", "duration", "observed", "x"), trees, [90.0, 180.0, 365.0]).drop("x")


_PAIRS = f"{_SCORES}, cells2 AS (SELECT p AS x, avg(y) AS y, count(*)::DOUBLE AS w FROM z GROUP BY 1)"


@query(_PAIRS + """, sums AS (SELECT x, w, sum(y * w) OVER o AS cy, sum(w) OVER o AS cw, y * w AS yw FROM cells2 WINDOW o AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
seg AS (SELECT a.x AS a, b.x AS b, (b.cy - a.cy + a.yw) / (b.cw - a.cw + a.w) AS mean FROM sums a JOIN sums b ON a.x <= b.x),
low AS (SELECT c.x, s.a, min(s.mean) AS mn FROM sums c JOIN seg s ON s.a <= c.x AND s.b >= c.x GROUP BY 1, 2), iso AS (SELECT x, max(mn) AS y FROM low GROUP BY 1),
blocks AS (SELECT (min(x) + max(x)) / 2 AS x, avg(y) AS y FROM iso GROUP BY round(y, 10)), k AS (SELECT * FROM blocks UNION ALL SELECT 0.0, 0.0 UNION ALL SELECT 1.0, 1.0), u AS (SELECT x, max(y) AS y FROM k GROUP BY 1)
SELECT round(x, 6) AS x, round(max(y) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING), 6) AS y FROM u""")
def isotonic_knots(spark, folder):
    split = _split(spark, folder)
    at = survival.survival_at(_train_curve(split), list(v.HORIZONS), ["segment"])
    test = split.where("split = 'test'").join(F.broadcast(at), "segment")
    pairs = test.select((1.0 - F.col("survival")).alias("p"), F.when((F.col("observed") == 1) & (F.col("duration") <= F.col("horizon")), 1.0).otherwise(0.0).alias("y"))
    knots = models.calibration_knots(pairs, "p", "y")
    return rounded(spark.createDataFrame(knots, "x double, y double"), "x", "y")


# --- scoring -----------------------------------------------------------------------------------------

_SCALE, _SHAPE = "(200.0::DOUBLE + price / 1000.0::DOUBLE)", "1.198::DOUBLE"
_GONE = f"(1 - exp(-pow(el / {_SCALE}, {_SHAPE})))"


def _open(spark, folder):
    c = v.cases(spark, folder, people=False).where("event = 0").withColumn("el", F.col("days").cast("double"))
    return c, models.conditional_weibull(F.lit(200.0) + F.col("price") / 1000.0, F.lit(1.198), F.col("el"))


@query(f"WITH {v.CASES}, o AS (SELECT *, days::DOUBLE AS el FROM cases WHERE event = 0) SELECT case_id, " + ", ".join(f"round(greatest(el, {_SCALE} * pow(-ln(1 - least(0.999999::DOUBLE, {_GONE} + {p}::DOUBLE * greatest(1e-9::DOUBLE, 1 - {_GONE}))), 1 / {_SHAPE})), 3) AS p{round(100 * p)}" for p in (0.1, 0.5, 0.8, 0.9)) + " FROM o")
def weibull_conditional_quantiles(spark, folder):
    c, cells = _open(spark, folder)
    return c.select("case_id", *[F.round(cells[f"p{p}"], 3).alias(f"p{p}") for p in (10, 50, 80, 90)])


@query(f"WITH {v.CASES}, o AS (SELECT *, days::DOUBLE AS el FROM cases WHERE event = 0) SELECT case_id, " + ", ".join(f"round(greatest(0, least(1, (1 - exp(-pow((el + {d}) / {_SCALE}, {_SHAPE})) - {_GONE}) / greatest(1e-9::DOUBLE, 1 - {_GONE}))), 5) AS within_{d}" for d in (30, 60, 90, 180)) + " FROM o")
def conditional_horizon_prob(spark, folder):
    c, cells = _open(spark, folder)
    return c.select("case_id", *[F.round(cells[f"within_{d}"], 5).alias(f"within_{d}") for d in (30, 60, 90, 180)])


@query()
def anchor_forecast(spark, folder):
    c = v.cases(spark, folder).where("event = 0").select("case_id", "segment", F.col("days").cast("double").alias("elapsed"))
    anchors = spark.createDataFrame([("AUTOMOBILE", 33.0, 110.0), ("BUILDING", 60.0, 300.0), ("FURNITURE", 45.0, 160.0), ("HOUSEHOLD", 80.0, 420.0), ("MACHINERY", 50.0, 240.0)], "segment string, p50 double, p90 double")
    return models.lognormal_quantiles(c.join(F.broadcast(anchors), "segment"), "elapsed", "p50", "p90")


# --- extensions --------------------------------------------------------------------------------------

@query("SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, folder):
    return streams.daily_counts_of(spark, folder)


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS first_ts, count(*)::BIGINT AS n FROM s GROUP BY user_id, k")
def session_counts(spark, folder):
    return streams.sessions(read_table(spark, folder, "events"), "30 minutes")


@query(f"WITH {v.CASES} SELECT segment, year(lodged)::BIGINT AS lodged_year, count(*)::BIGINT AS cases, sum(event)::BIGINT AS events FROM cases GROUP BY ROLLUP (segment, year(lodged)::BIGINT)")
def profile_rollup(spark, folder):
    return v.cases(spark, folder).withColumn("lodged_year", F.year("lodged").cast("long")).rollup("segment", "lodged_year").agg(F.count("*").alias("cases"), F.sum("event").alias("events"))


@query()
def approx_users(spark, folder):
    return read_table(spark, folder, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@query("WITH s AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'signup' GROUP BY 1), p AS (SELECT s.user_id, t0, min(ts) AS t1 FROM s LEFT JOIN events e ON e.user_id = s.user_id AND event_type = 'purchase' AND ts >= t0 GROUP BY 1, 2) SELECT user_id, (t1 IS NOT NULL)::BIGINT AS event, datediff('day', t0::DATE, coalesce(t1, TIMESTAMP '2024-01-31')::DATE)::BIGINT AS days FROM p")
def event_stream_cases(spark, folder):
    e = read_table(spark, folder, "events")
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("t0"))
    bought = e.where("event_type = 'purchase'").select("user_id", "ts").join(first, "user_id").where("ts >= t0").groupBy("user_id").agg(F.min("ts").alias("t1"))
    days = F.datediff(F.coalesce(F.to_date("t1"), F.lit("2024-01-31").cast("date")), F.to_date("t0"))
    return first.join(bought, "user_id", "left").select("user_id", F.col("t1").isNotNull().cast("long").alias("event"), days.cast("long").alias("days"))
