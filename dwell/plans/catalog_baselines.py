"""Registered queries: models as columns and their evaluation, the anchor engine, checks of flows and cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwell.operators import evaluate, flows, predictors, quality, survival
from dwell.plans import anchors, charts, training
from dwell.plans import views as v
from dwell.plans.catalog import _COHORT, _km_sql, _weighted, longs, query, rounded
from dwell.plans.catalog_models import _SPLIT, _USABLE, _encoded, _split

# --- models as columns --------------------------------------------------------------------------------

LEVELS = [["segment", "priority"], ["segment"], []]
_HORIZONS = ("90", "180", "365")
_SUMMARY = ", ".join(f"min(days) FILTER (round(s, 12) <= round(1 - {p}::DOUBLE, 12)) AS p{round(100 * p)}" for p in (0.1, 0.5, 0.9)) + ", " + ", ".join(f"coalesce(arg_max(s, days) FILTER (days <= {h}), 1.0) AS s_{h}" for h in _HORIZONS)


def _strata_sql(levels: list[list[str]]) -> str:
    """CTEs train, test and scored: test rows with the summary of their first stratum that is large enough."""
    name = lambda by: "|".join(by)
    key = lambda by: " || '|' || ".join(by) if by else "''"
    parts = " UNION ALL ".join(f"SELECT '{name(by)}#' || {key(by)} AS k, duration, observed FROM train" for by in levels)
    joins = " ".join(f"LEFT JOIN big b{i} ON b{i}.k = '{name(by)}#' || {key(by)}" for i, by in enumerate(levels))
    return f"""train AS (SELECT * FROM split WHERE split = 'train'), test AS (SELECT * FROM split WHERE split = 'test'),
q AS ({parts}), big AS (SELECT k FROM q GROUP BY 1 HAVING (count(*) >= 40 AND sum(observed) >= 15) OR k = '#'), p AS (SELECT q.* FROM q JOIN big ON q.k = big.k),
{_km_sql('p', by='k', days='duration', event='observed')}, m AS (SELECT k, {_SUMMARY} FROM curve GROUP BY 1),
scored AS (SELECT t.*, m.* EXCLUDE (k), -coalesce(nullif(p50, 0), 1e9::DOUBLE) AS risk FROM (SELECT test.*, coalesce({', '.join(f'b{i}.k' for i in range(len(levels)))}) AS mk FROM test {joins}) t JOIN m ON m.k = t.mk)"""


def _evaluation_sql(model: str, scored: str = "scored") -> str:
    """One row of what is reported of a model over the CTE ``scored``."""
    horizons = ", ".join(
        f"round(avg(pow(1 - s_{h} - y{h}, 2)), 4) AS brier_{h}, round(avg(1 - s_{h}), 4) AS mean_predicted_{h}, round(avg(y{h}), 4) AS observed_fraction_{h}, round(avg(1 - s_{h}) - avg(y{h}), 4) AS calibration_gap_{h}" for h in _HORIZONS)
    actual = ", ".join(f"(observed = 1 AND duration <= {h})::INT::DOUBLE AS y{h}" for h in _HORIZONS)
    return f"""SELECT '{model}' AS model, count(*)::BIGINT AS test_rows, sum(observed)::BIGINT AS test_events, sum(1 - observed)::BIGINT AS test_censored,
round(median(abs(duration - p50)) FILTER (observed = 1), 1) AS event_only_median_absolute_error_days, round(avg((duration BETWEEN p10 AND p90)::INT) FILTER (observed = 1 AND p10 IS NOT NULL AND p90 IS NOT NULL), 4) AS event_only_p10_p90_coverage,
count(*) FILTER (observed = 1 AND p10 IS NOT NULL AND p90 IS NOT NULL)::BIGINT AS event_only_interval_rows, {horizons}, any_value(c.h) AS harrell_c_index, any_value(c.n) AS comparable_pairs
FROM (SELECT *, {actual} FROM {scored}) z, (SELECT sum(a.e * b.n)::BIGINT AS n, round(sum(a.e * b.n * CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) / sum(a.e * b.n), 4) AS h
  FROM (SELECT duration, risk, count(*) AS n, sum(observed) AS e FROM {scored} GROUP BY 1, 2) a JOIN (SELECT duration, risk, count(*) AS n FROM {scored} GROUP BY 1, 2) b ON a.duration < b.duration AND a.e > 0) c"""


def _by_strata(spark, folder, levels=LEVELS):
    split = _split(spark, folder)
    tables = predictors.fit_strata(split.where("split = 'train'"), levels)
    return predictors.predict_strata(split.where("split = 'test'"), tables)


@query(f"WITH {v.CASES}, {_SPLIT}, {_strata_sql(LEVELS)} SELECT case_id, p10, p50, p90, round(s_90, 6) AS s_90, round(s_180, 6) AS s_180, round(s_365, 6) AS s_365 FROM scored")
def stratified_predict(spark, folder):
    return rounded(_by_strata(spark, folder).select("case_id", *predictors.outputs()), "s_90", "s_180", "s_365")


@query(f"WITH {v.CASES}, {_SPLIT}, {_strata_sql(LEVELS)} {_evaluation_sql('kaplan_meier_stratified')}")
def evaluate_stratified(spark, folder):
    return evaluate.evaluate_model(_by_strata(spark, folder), "kaplan_meier_stratified")


_RANKED = {"global": [[]], "by_segment": [["segment"], []], "by_segment_and_priority": LEVELS}


@query(f"WITH {v.CASES}, {_SPLIT}, " + ", ".join(f"e_{n} AS (WITH {_strata_sql(by)} {_evaluation_sql(n)})" for n, by in _RANKED.items()) + ", e AS (" + " UNION ALL ".join(f"SELECT * FROM e_{n}" for n in _RANKED) + ") SELECT model, harrell_c_index, brier_180, row_number() OVER (ORDER BY harrell_c_index DESC NULLS LAST, brier_180, model)::BIGINT AS place FROM e")
def model_ranking(spark, folder):
    found = None
    for name, levels in _RANKED.items():
        row = evaluate.evaluate_model(_by_strata(spark, folder, levels), name)
        found = row if found is None else found.unionByName(row)
    return longs(training.rank_models(found.select("model", "harrell_c_index", "brier_180")), "place")


_ETA = "(0.3::DOUBLE * (segment = 'BUILDING')::INT - 0.2::DOUBLE * (priority = '1-URGENT')::INT)"


@query(f"""WITH {v.CASES}, {_SPLIT}, x AS (SELECT *, {_ETA} AS eta FROM split), c AS (SELECT duration AS days, sum(observed) AS e, sum(exp(eta)) AS r FROM x WHERE split = 'train' GROUP BY 1),
a AS (SELECT days, e, sum(r) OVER (ORDER BY days DESC ROWS UNBOUNDED PRECEDING) AS at_risk FROM c), h AS (SELECT days, sum(e / at_risk) OVER (ORDER BY days ROWS UNBOUNDED PRECEDING) AS hazard FROM a WHERE e > 0),
g AS (SELECT eta, {', '.join(f"coalesce(max(hazard) FILTER (days <= {d}), 0) AS h{d}" for d in _HORIZONS)}, {', '.join(f"min(days) FILTER (round(exp(-hazard * exp(eta)), 12) <= round(1 - {p}::DOUBLE, 12)) AS p{round(100 * p)}" for p in (0.1, 0.5, 0.9))} FROM (SELECT DISTINCT eta FROM x), h GROUP BY 1)
SELECT case_id, round(x.eta, 6) AS risk, p10, p50, p90, {', '.join(f"round(exp(-h{d} * exp(x.eta)), 6) AS s_{d}" for d in _HORIZONS)} FROM x JOIN g ON x.eta = g.eta WHERE split = 'test'""")
def cox_survival(spark, folder):
    split = _split(spark, folder)
    eta = F.lit(0.3) * (F.col("segment") == "BUILDING").cast("int") - F.lit(0.2) * (F.col("priority") == "1-URGENT").cast("int")
    hazard = [(r["days"], r["hazard"]) for r in predictors.breslow(split.where("split = 'train'"), eta).orderBy("days").collect()]  # one a duration
    found = predictors.predict_cox(split.where("split = 'test'"), eta, hazard)
    return rounded(found.select("case_id", "risk", *predictors.outputs()), "risk", "s_90", "s_180", "s_365")


#: Knots of a fixed calibration map.
KNOTS = [(0.0, 0.0), (0.2, 0.1), (0.6, 0.7), (1.0, 1.0)]
_SCALE = "(40.0::DOUBLE + price / 5000.0::DOUBLE)"
_MAPPED = lambda p: f"(CASE WHEN {p} <= 0.2 THEN {p} * 0.5 WHEN {p} <= 0.6 THEN 0.1 + ({p} - 0.2) * 1.5 ELSE 0.7 + ({p} - 0.6) * 0.75 END)"


@query(f"WITH {v.CASES}, {_SPLIT} SELECT case_id, round(-{_SCALE}, 6) AS risk, " + ", ".join(f"round({_SCALE} * pow(-ln(1 - {raw}::DOUBLE), 1 / 1.2::DOUBLE), 6) AS p{p}" for p, raw in ((10, "0.2"), (50, "(0.2 + 0.4 / 1.5)"), (90, "(0.6 + 0.2 / 0.75)"))) + ", " + ", ".join(f"round(1 - {_MAPPED(f'(1 - exp(-pow({h}.0::DOUBLE / {_SCALE}, 1.2::DOUBLE)))')}, 6) AS s_{h}" for h in _HORIZONS) + " FROM split WHERE split = 'test'")
def calibrated_scores(spark, folder):
    test = _split(spark, folder, False).where("split = 'test'")
    found = predictors.predict_weibull(test, F.lit(40.0) + F.col("price") / 5000.0, 1.2, KNOTS)
    return rounded(found.select("case_id", "risk", *predictors.outputs()), "risk", *predictors.outputs())


_PAIRS = f"""WITH {v.CASES}, {_SPLIT}, {_strata_sql([['segment'], []])}, pairs AS (SELECT 1 - s AS p, (observed = 1 AND duration <= h)::INT AS y FROM (
  {' UNION ALL '.join(f'SELECT duration, observed, {h} AS h, s_{h} AS s FROM scored' for h in _HORIZONS)}) WHERE NOT (observed = 0 AND duration < h))"""


@query(_PAIRS + """, cells2 AS (SELECT p AS x, avg(y) AS y, count(*)::DOUBLE AS w FROM pairs GROUP BY 1), sums AS (SELECT x, w, sum(y * w) OVER o AS cy, sum(w) OVER o AS cw, y * w AS yw FROM cells2 WINDOW o AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
seg AS (SELECT a.x AS a, b.x AS b, (b.cy - a.cy + a.yw) / (b.cw - a.cw + a.w) AS mean FROM sums a JOIN sums b ON a.x <= b.x),
low AS (SELECT c.x, s.a, min(s.mean) AS mn FROM sums c JOIN seg s ON s.a <= c.x AND s.b >= c.x GROUP BY 1, 2), iso AS (SELECT x, max(mn) AS y FROM low GROUP BY 1),
blocks AS (SELECT (min(x) + max(x)) / 2 AS x, avg(y) AS y FROM iso GROUP BY round(y, 10)), k AS (SELECT * FROM blocks UNION ALL SELECT 0.0, 0.0 UNION ALL SELECT 1.0, 1.0), u AS (SELECT x, max(y) AS y FROM k GROUP BY 1)
SELECT round(x, 6) AS x, round(max(y) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING), 6) AS y FROM u""")
def calibration_knots(spark, folder):
    knots = predictors.fit_calibrator(_by_strata(spark, folder, [["segment"], []]))
    return rounded(spark.createDataFrame(knots, "x double, y double"), "x", "y")


_SIX = ["segment=BUILDING", "segment=FURNITURE", "segment=HOUSEHOLD", "segment=MACHINERY", "priority=2-HIGH", "priority=3-MEDIUM"]


@query(f"WITH {v.CASES}, {_SPLIT}, c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(corr(({n.split('=')[0]} = '{n.split('=')[1]}')::INT, duration), 5) AS coefficient FROM split WHERE split = 'train'" for n in _SIX) + ") SELECT * FROM c ORDER BY abs(coefficient) DESC, feature LIMIT 4")
def top_coefficients(spark, folder):
    encoder, rows = _encoded(spark, folder)
    columns = encoder.columns()
    train = rows.where("split = 'train'").agg(*[F.corr(columns[n], "duration").alias(n) for n in _SIX]).first()
    return spark.createDataFrame([(r["feature"], r["coefficient"]) for r in predictors.top_coefficients(_SIX, [train[n] for n in _SIX], 4)], "feature string, coefficient double")


# --- the anchor engine --------------------------------------------------------------------------------

_TIER_WEIGHT = "CASE tier WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.9 WHEN 'B-C' THEN 0.8 WHEN 'C' THEN 0.7 WHEN 'D' THEN 0.45 ELSE 0.5 END"
_MEDIANS = "min(days) FILTER (round(s, 12) <= round(1 - 0.1::DOUBLE, 12)) AS p10, min(days) FILTER (round(s, 12) <= round(1 - 0.5::DOUBLE, 12)) AS p50, min(days) FILTER (round(s, 12) <= round(1 - 0.9::DOUBLE, 12)) AS p90"


def _observations(spark, folder):
    return v.cases(spark, folder).withColumnRenamed("tier", "source_quality_tier")


@query(f"""WITH {v.CASES}, k AS (SELECT *, event = 1 AND decided <= DATE '{v.CUTOFF}' AS known FROM cases WHERE lodged <= DATE '{v.CUTOFF}'),
u AS (SELECT CASE WHEN known THEN days ELSE DATE '{v.CUTOFF}' - lodged END AS days, coalesce(known, false)::INT AS event, pow(0.5::DOUBLE, greatest(0, DATE '{v.CUTOFF}' - CASE WHEN known THEN as_of ELSE DATE '{v.CUTOFF}' END) / 540.0::DOUBLE) * greatest(0.1::DOUBLE, quality / 100.0::DOUBLE) * {_TIER_WEIGHT} AS w FROM k),
{_km_sql('u', weight='w')}, q AS (SELECT {_MEDIANS} FROM curve), l AS (SELECT days::DOUBLE AS actual FROM k WHERE event = 1 AND decided > DATE '{v.CUTOFF}'),
s AS (SELECT count(*)::BIGINT AS test_events, round(avg((actual BETWEEN p10 AND p90)::INT), 6) AS coverage, list_sort(list(abs(actual - p50))) AS e FROM l, q)
SELECT p10, p50, p90, test_events, coverage, e[len(e) // 2 + 1] AS median_error FROM q, s""")
def retro_backtest_weighted(spark, folder):
    return rounded(longs(anchors.retrospective_backtest(_observations(spark, folder), v.CUTOFF), "test_events"), "coverage")


@query(f"""WITH {v.CASES}, w AS (SELECT *, pow(0.5::DOUBLE, greatest(0, DATE '{v.SNAPSHOT}' - as_of) / 540.0::DOUBLE) * greatest(0.1::DOUBLE, quality / 100.0::DOUBLE) * {_TIER_WEIGHT} AS w FROM cases),
g AS (SELECT segment, pow(sum(w), 2) / sum(w * w) AS n_eff, sum(event) AS events, avg(quality) AS quality, DATE '{v.SNAPSHOT}' - max(as_of) AS recency FROM w WHERE days > 40 GROUP BY 1),
p AS (SELECT segment, least(20, floor(n_eff / 10))::INT AS effective_sample, least(10, floor(events / 10))::INT AS observed_events, least(10, round_even(quality / 10, 0))::INT AS row_quality, greatest(0, 10 - floor(greatest(0, recency) / 60))::INT AS recency FROM g)
SELECT *, score, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade FROM (SELECT *, least(80, greatest(0, 40 + effective_sample + observed_events + row_quality + recency - 15))::INT AS score FROM p)""".replace("SELECT *, score, CASE", "SELECT *, CASE"))
def anchor_confidence(spark, folder):
    w = _weighted(spark, folder).where("days > 40").groupBy("segment").agg(survival.effective_size(F.col("weight")).alias("n_eff"), F.sum("event").alias("events"), F.avg("quality").alias("mean_quality"), F.datediff(F.lit(v.SNAPSHOT).cast("date"), F.max("as_of")).alias("recency_days"))
    parts = anchors.confidence_parts(F.col("n_eff"), F.col("events"), F.col("mean_quality"), F.col("recency_days"))
    score = anchors.confidence_score(parts)
    return w.select("segment", *[parts[n].cast("int").alias(n) for n in ("effective_sample", "observed_events", "row_quality", "recency")], score.cast("int").alias("score"), anchors.grade(score).alias("grade"))


_ANCHORS = [("AUTOMOBILE", 33.0, 110.0), ("BUILDING", 60.0, 300.0), ("FURNITURE", 45.0, 160.0), ("HOUSEHOLD", 80.0, 420.0), ("MACHINERY", 50.0, 240.0)]


@query(f"WITH {v.CASES}, a(stream, p50, p90) AS (VALUES {', '.join(map(str, _ANCHORS))}) SELECT case_id, p50::DOUBLE AS p50, p90::DOUBLE AS p90 FROM cases JOIN a ON segment = stream WHERE event = 0")
def anchor_lookup(spark, folder):
    table = spark.createDataFrame(_ANCHORS, "stream string, p50 double, p90 double")
    return anchors.with_anchor(v.cases(spark, folder).where("event = 0").select("case_id", "segment"), table, F.col("segment")).drop("segment")


@query(f"WITH {v.CASES} SELECT region, count(*)::BIGINT AS cases, max(as_of) AS reference_date FROM cases WHERE segment = 'BUILDING' GROUP BY 1")
def wildcard_cohorts(spark, folder):
    asked = anchors.matching({"segment": "BUILDING", "priority": "any", "region": "", "nation": "Unknown"})
    return v.cases(spark, folder).where(asked).groupBy("region").agg(F.count("*").alias("cases"), F.max("as_of").alias("reference_date"))


@query()
def multiplier_interval(spark, folder):
    w = _weighted(spark, folder)
    broad = survival.crossings(survival.km_curve(w, weight="weight"), None, (0.5,)).first()["p50"]
    found = anchors.multiplier_interval(w.where(_COHORT), broad, coarse="lodged", fine="case_id")
    return spark.createDataFrame([found or (None, None)], "low double, high double")


# --- flows and cases ----------------------------------------------------------------------------------

_F = v.flows_sql("f")
_TWICE = "(SELECT activity_month, activity_type, \"count\" + 5 AS \"count\", 0 AS seq FROM f WHERE activity_month >= '1998-01' UNION ALL SELECT activity_month, activity_type, \"count\" - (activity_type = 'granted')::INT, 1 FROM f)"


@query(f"""WITH {v.CASES}, {_F}, p AS (SELECT activity_month, activity_type, arg_max("count", seq) AS prior_count FROM {_TWICE} GROUP BY 1, 2)
SELECT activity_month, activity_type, "count"::BIGINT AS new_count, prior_count::BIGINT AS prior_count, ("count" - prior_count)::BIGINT AS difference FROM f JOIN p USING (activity_month, activity_type) WHERE "count" <> prior_count""")
def flow_revisions_of_repeats(spark, folder):
    f = v.monthly_flows(spark, folder)
    first = f.where("activity_month >= '1998-01'").select("activity_month", "activity_type", (F.col("count") + 5).alias("count"), F.lit(0).alias("seq"))
    last = f.select("activity_month", "activity_type", (F.col("count") - (F.col("activity_type") == "granted").cast("long")).alias("count"), F.lit(1).alias("seq"))
    return flows.revisions(f, first.unionByName(last), "seq")


@query(f"""WITH {v.CASES}, {_F}, t AS (SELECT 'v1' AS vintage, * FROM f UNION ALL SELECT 'v1', activity_month, activity_type, -1 FROM f WHERE activity_month = '1996-03')
SELECT 'duplicate_grain' AS issue, concat_ws('|', vintage, activity_month, activity_type) AS detail FROM t GROUP BY vintage, activity_month, activity_type HAVING count(*) > 1
UNION ALL SELECT 'negative_count', concat_ws('|', vintage, activity_month, activity_type) FROM t WHERE "count" < 0
UNION ALL SELECT 'missing_activity_type', '' FROM (SELECT list_sort(list(DISTINCT activity_type)) AS l FROM t) WHERE l IS DISTINCT FROM ['granted', 'lodged']
UNION ALL SELECT 'duplicate_month', activity_type FROM t GROUP BY activity_type HAVING count(*) > count(DISTINCT activity_month)
UNION ALL SELECT 'unexpected_coverage', concat_ws(':', activity_type, min(activity_month), max(activity_month)) FROM t GROUP BY activity_type HAVING min(activity_month) <> '1995-01' OR max(activity_month) < '2001-08'""")
def flow_validation(spark, folder):
    f = v.monthly_flows(spark, folder)
    wrong = f.where("activity_month = '1996-03'").withColumn("count", F.lit(-1).cast("long"))
    return flows.validation_issues(f.unionByName(wrong).withColumn("source_snapshot_date", F.lit("v1")), "1995-01", "2001-08")


@query(f"WITH {v.DIRTY_SQL}, x AS (SELECT *, event IS NOT NULL AND waiting IS NOT NULL AND quality IS NOT NULL AS ok FROM dirty) " + " UNION ALL ".join(f"SELECT '{c}' AS field, round(avg((ok AND lower(trim(coalesce({c}, ''))) IN ('', 'unknown', '(blank)'))::INT), 4) AS rate FROM x" for c in ("mode", "band")))
def unknown_rates_of_valid(spark, folder):
    rows = v.dirty_cases(spark, folder)
    return quality.unknown_rates(rows, ["mode", "band"], quality.numeric(rows))


@query(f"WITH {v.DIRTY_SQL} SELECT record_id, waiting::BIGINT AS claimed, computed::BIGINT AS computed, coalesce(waiting = computed, false) AS consistent FROM (SELECT *, CASE WHEN event = 1 THEN decided ELSE snapshot END - lodged AS computed FROM dirty WHERE {_USABLE})")
def claimed_and_computed(spark, folder):
    rows = v.dirty_cases(spark, folder)
    return quality.claimed_and_computed(rows.where(quality.usable(rows))).select("record_id", "claimed", "computed", "consistent")


@query(f"""WITH {v.CASES}, {_F} SELECT substr(activity_month, 1, 4) AS activity_year, sum("count") FILTER (activity_type = 'lodged')::BIGINT AS lodged, sum("count") FILTER (activity_type = 'granted')::BIGINT AS finalised,
round(sum("count") FILTER (activity_type = 'granted') / sum("count") FILTER (activity_type = 'lodged'), 4) AS flow_rate FROM f GROUP BY 1""")
def yearly_flow_rate(spark, folder):
    return flows.flow_rate(v.monthly_flows(spark, folder).withColumn("activity_year", F.substring("activity_month", 1, 4)), "activity_year")


@query(f"WITH {v.CASES}, m AS (SELECT month, sum(l)::BIGINT AS lodged, sum(g)::BIGINT AS granted FROM (SELECT strftime(lodged, '%Y-%m') AS month, 1 AS l, 0 AS g FROM cases UNION ALL SELECT strftime(decided, '%Y-%m'), 0, 1 FROM cases WHERE decided IS NOT NULL) GROUP BY 1 ORDER BY 1 DESC LIMIT 30) SELECT * FROM m")
def case_volume(spark, folder):
    rows = v.cases(spark, folder, people=False).select(F.col("lodged").cast("string").alias("lodgement_date"), F.col("decided").cast("string").alias("decision_date"))
    return charts.case_volume(rows)
