"""The registered queries of the engine and the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.functions import rules
from dwell.functions.records import PENALTIES, normalize_cases
from dwell.operators import evaluate, flows, quality, survival
from dwell.plans import views as v
from dwell.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# --- survival curves -------------------------------------------------------------------------------

def _km_sql(source: str, by: str = "", weight: str = "1.0", days: str = "days", event: str = "event") -> str:
    """CTEs cells, curve of a (weighted) curve over ``source``, partitioned by ``by``."""
    part, lead = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    group = f"{by}, 2" if by else "1"
    return f"""cells AS (SELECT {lead}{days}::DOUBLE AS days, sum({weight} * {event}) AS e, sum({weight}) AS n FROM {source} GROUP BY {group}),
risk AS (SELECT *, sum(n) OVER ({part}ORDER BY days DESC ROWS UNBOUNDED PRECEDING) AS r FROM cells),
steps AS (SELECT {lead}days, e, product(greatest(0, 1 - e / r)) OVER ({part}ORDER BY days ROWS UNBOUNDED PRECEDING) AS s FROM risk),
curve AS (SELECT {lead}days, s FROM steps WHERE e > 0 UNION ALL SELECT DISTINCT {lead}0.0::DOUBLE, 1.0::DOUBLE FROM steps)"""


@query(f"WITH {v.CASES}, {_km_sql('cases')} SELECT days, round(s, 6) AS survival FROM curve")
def km_curve_global(spark, folder):
    return rounded(survival.km_curve(v.cases(spark, folder, people=False)), "survival")


@query(f"WITH {v.CASES}, {_km_sql('cases')} SELECT min(days) FILTER (round(s, 12) <= round(1 - 0.1::DOUBLE, 12)) AS p10, min(days) FILTER (round(s, 12) <= round(1 - 0.5::DOUBLE, 12)) AS p50, min(days) FILTER (round(s, 12) <= round(1 - 0.9::DOUBLE, 12)) AS p90 FROM curve")
def km_quantiles_global(spark, folder):
    return survival.crossings(survival.km_curve(v.cases(spark, folder, people=False)))


_WEIGHT = f"(pow(0.5::DOUBLE, greatest(0, DATE '{v.SNAPSHOT}' - as_of) / 540.0::DOUBLE) * greatest(0.1::DOUBLE, quality / 100.0::DOUBLE) * CASE tier WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.9 WHEN 'B-C' THEN 0.8 WHEN 'C' THEN 0.7 WHEN 'D' THEN 0.45 ELSE 0.5 END)"


def _weighted(spark, folder):
    w = survival.weights(F.col("as_of"), F.col("quality"), F.col("tier"), F.lit(v.SNAPSHOT).cast("date"))
    return v.cases(spark, folder).withColumn("weight", w)


@query(f"WITH {v.CASES}, {_km_sql('cases', weight=_WEIGHT)} SELECT days, round(s, 6) AS survival FROM curve")
def km_weighted(spark, folder):
    return rounded(survival.km_curve(_weighted(spark, folder), weight="weight"), "survival")


@query(f"WITH {v.CASES}, {_km_sql('cases', by='segment')} SELECT segment, days, round(s, 6) AS survival FROM curve")
def km_stratified(spark, folder):
    return rounded(survival.km_curve(v.cases(spark, folder), ["segment"]), "survival")


@query(f"""WITH {v.CASES},
q AS (SELECT 'region|segment|priority' AS fields, concat_ws('|', region, segment, priority) AS key, days, event FROM cases UNION ALL SELECT 'region|segment', concat_ws('|', region, segment), days, event FROM cases UNION ALL SELECT '', '', days, event FROM cases),
big AS (SELECT fields, key FROM q GROUP BY ALL HAVING (count(*) >= 40 AND sum(event) >= 15) OR fields = ''),
p AS (SELECT q.fields || '#' || q.key AS k, days, event FROM q JOIN big ON q.fields = big.fields AND q.key = big.key),
{_km_sql('p', by='k')},
m AS (SELECT k, min(days) FILTER (round(s, 12) <= round(1 - 0.1::DOUBLE, 12)) AS p10, min(days) FILTER (round(s, 12) <= round(1 - 0.5::DOUBLE, 12)) AS p50, min(days) FILTER (round(s, 12) <= round(1 - 0.9::DOUBLE, 12)) AS p90 FROM curve GROUP BY 1)
SELECT CASE WHEN k LIKE 'region|segment|priority#%' THEN 0 WHEN k LIKE 'region|segment#%' THEN 1 ELSE 2 END::BIGINT AS level, substr(k, position('#' IN k) + 1) AS key, p10, p50, p90 FROM m""")
def km_fallback_strata(spark, folder):
    c = v.cases(spark, folder)
    return longs(survival.stratified_with_fallback(c, [["region", "segment", "priority"], ["region", "segment"], []]), "level")


@query(f"""WITH {v.CASES}, {_km_sql('cases', by='segment')}, h(horizon) AS (VALUES (90.0::DOUBLE), (180.0), (365.0))
SELECT segment, horizon, round(coalesce(arg_max(s, days) FILTER (days <= horizon), 1.0), 6) AS survival FROM curve, h GROUP BY 1, 2""")
def km_survival_at_horizons(spark, folder):
    curve = survival.km_curve(v.cases(spark, folder), ["segment"])
    return rounded(survival.survival_at(curve, list(v.HORIZONS), ["segment"]), "survival")


@query(f"WITH {v.CASES} SELECT segment, round(pow(sum({_WEIGHT}), 2) / sum({_WEIGHT} * {_WEIGHT}), 4) AS effective_size FROM cases GROUP BY 1")
def ess_by_segment(spark, folder):
    return _weighted(spark, folder).groupBy("segment").agg(F.round(survival.effective_size(F.col("weight")), 4).alias("effective_size"))


@query(f"""WITH {v.CASES}, u AS (SELECT segment || '' AS g, days, event, {_WEIGHT} AS w FROM cases UNION ALL SELECT '*', days, event, {_WEIGHT} FROM cases),
{_km_sql('u', by='g', weight='w')}, m AS (SELECT g, min(days) FILTER (round(s, 12) <= round(1 - 0.5::DOUBLE, 12)) AS med FROM curve GROUP BY 1),
n AS (SELECT g, pow(sum(w), 2) / sum(w * w) AS n_eff FROM u GROUP BY 1),
r AS (SELECT m.g, n_eff, CASE WHEN m.med <> 0 AND b.med > 0 THEN least(2, greatest(0.5, m.med / b.med)) ELSE 1 END AS ratio FROM m JOIN n ON m.g = n.g, (SELECT med FROM m WHERE g = '*') b WHERE m.g <> '*')
SELECT g AS segment, round(ratio, 6) AS raw_ratio, round(n_eff / (n_eff + 80), 6) AS shrinkage, round(exp(ln(ratio) * n_eff / (n_eff + 80)), 6) AS multiplier FROM r""")
def cohort_adjustment(spark, folder):
    w = _weighted(spark, folder)
    target = survival.crossings(survival.km_curve(w, ["segment"], weight="weight"), ["segment"], (0.5,))
    broad = survival.crossings(survival.km_curve(w, weight="weight"), None, (0.5,)).select(F.col("p50").alias("broad"))
    size = w.groupBy("segment").agg(survival.effective_size(F.col("weight")).alias("n_eff"))
    both = target.join(size, "segment").join(F.broadcast(broad))  # one row
    ratio = F.when((F.col("p50") != 0) & (F.col("broad") > 0), F.least(F.lit(2.0), F.greatest(F.lit(0.5), F.col("p50") / F.col("broad")))).otherwise(1.0)
    shrink = F.col("n_eff") / (F.col("n_eff") + 80)
    return rounded(both.select("segment", ratio.alias("raw_ratio"), shrink.alias("shrinkage"), F.exp(F.log(ratio) * shrink).alias("multiplier")), "raw_ratio", "shrinkage", "multiplier")


_COHORT = "segment = 'BUILDING' AND priority = '1-URGENT'"


@query(f"""WITH {v.CASES}, k AS (SELECT row_number() OVER (ORDER BY lodged, case_id) - 1 AS idx, days, event FROM cases WHERE {_COHORT}),
t AS (SELECT count(*) AS n FROM k), g AS (SELECT run, ('0x' || substr(sha256(run || '-' || idx), 1, 8))::BIGINT % n AS idx FROM k, t, range(40) z(run)),
u AS (SELECT run, days, event FROM g JOIN k USING (idx)), {_km_sql('u', by='run')},
m AS (SELECT run, min(days) FILTER (round(s, 12) <= round(1 - 0.5::DOUBLE, 12)) AS p50 FROM curve GROUP BY 1), o AS (SELECT list(p50 ORDER BY p50) AS l FROM m WHERE p50 IS NOT NULL)
SELECT l[floor(0.025 * (len(l) - 1))::INT + 1] AS lower, l[floor(0.975 * (len(l) - 1))::INT + 1] AS upper FROM o""")
def bootstrap_median_ci(spark, folder):
    cohort = v.cases(spark, folder).where(_COHORT)
    return survival.nearest_rank(survival.bootstrap_medians(cohort, 40), "p50", {"lower": 0.025, "upper": 0.975})


@query(f"""WITH {v.CASES}, e AS (SELECT days, sum(event) AS d FROM cases GROUP BY 1 HAVING sum(event) > 0),
g AS (SELECT segment, days, count(*) AS n, sum(event) AS e FROM cases GROUP BY 1, 2),
p AS (SELECT s.segment, e.days, e.d, (SELECT count(*) FROM cases c WHERE c.days >= e.days) AS r FROM e, (SELECT DISTINCT segment FROM cases) s),
q AS (SELECT p.*, coalesce((SELECT sum(n) FROM g WHERE g.segment = p.segment AND g.days >= p.days), 0)::DOUBLE AS own, coalesce(g.e, 0) AS oe FROM p LEFT JOIN g ON g.segment = p.segment AND g.days = p.days),
z AS (SELECT segment, sum(oe - d * own / r) AS o, sum(CASE WHEN r > 1 THEN own * (r - own) * d * (r - d) / (r::DOUBLE * r * (r - 1)) ELSE 0 END) AS var FROM q GROUP BY 1)
SELECT segment, round(o, 5) AS observed_minus_expected, round(var, 5) AS variance, round(o * o / var, 5) AS score FROM z""")
def logrank_by_segment(spark, folder):
    return rounded(survival.logrank(v.cases(spark, folder), "segment"), "observed_minus_expected", "variance", "score", places=5)


# --- records ----------------------------------------------------------------------------------------

def _has(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _case(x: str, pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {_has(x, words)} THEN '{value}'" for value, words in pairs) + f" ELSE '{default}' END"


def _plain(c: str) -> str:
    return f"lower(trim(coalesce({c}, '')))"


def _bool(c: str) -> str:
    quoted = lambda s: ", ".join(f"'{x}'" for x in s)
    return f"CASE WHEN {_plain(c)} IN ({quoted(rules.YES)}) THEN 'yes' WHEN {_plain(c)} IN ({quoted(rules.NO)}) THEN 'no' ELSE 'unknown' END"


def _date(c: str) -> str:
    return f"CASE WHEN regexp_matches(substr({c}, 1, 10), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_cast(substr({c}, 1, 10) AS DATE) END"


_PROVIDER = f"CASE WHEN coalesce(trim(\"schoolType\"), '') = '' THEN 'Unknown' WHEN {_has(f'''regexp_replace({_plain(chr(34) + 'schoolType' + chr(34))}, '\\s+', ' ', 'g')''', rules.GROUP_OF_EIGHT)} THEN 'Group of Eight' ELSE 'Other/Unverified' END"
_JSON = "'{' || " + " || ', ' || ".join(f"""'"{n}": ' || coalesce(to_json("{n}")::VARCHAR, 'null')""" for n in sorted(v.RAW)) + " || '}'"
_NORMAL = f"""{v.RAW_SQL},
a AS (SELECT *, {_date('"submitTime"')} AS lodged, {_date('"getVisaTime"')} AS decided, {_bool('"ifGetVisa"')} = 'yes' AS claimed,
  {_case(_plain('"educationLevel"'), [(l, w) for l, _, w in rules.EDUCATION], 'Unknown')} AS education_level, {_case(_plain('"educationLevel"'), [(s, w) for _, s, w in rules.EDUCATION], 'Unknown')} AS study_sector,
  CASE WHEN {_plain('"major"')} = '' THEN 'Unknown' ELSE {_case(_plain('"major"'), rules.FIELDS, 'Other')} END AS field_of_study_group,
  {_case(_plain('"submitPlace"'), [('Outside Australia', rules.OUTSIDE), ('In Australia', rules.INSIDE)], 'Unknown')} AS submit_location,
  CASE WHEN {_has(_plain('"ifIncludedCouple"'), rules.PARTNER_YES)} THEN 'yes' WHEN {_has(_plain('"ifIncludedCouple"'), rules.PARTNER_NO)} THEN 'no' ELSE {_bool('"ifIncludedCouple"')} END AS includes_partner,
  {_bool('"ifDIY"')} AS is_diy, {_PROVIDER} AS provider_group, DATE '{v.SNAPSHOT}' AS snap FROM raw),
b AS (SELECT *, (claimed AND decided IS NOT NULL)::INT AS event, CASE WHEN claimed AND decided IS NOT NULL THEN decided ELSE snap END AS until FROM a),
c AS (SELECT *, until - lodged AS waiting, [lodged IS NULL, claimed AND decided IS NULL, decided < lodged, lodged > snap, (until - lodged) < 0 OR (until - lodged) > 3650, education_level = 'Unknown', submit_location = 'Unknown', coalesce("_id", '') = ''] AS wrong FROM b),
normal AS (SELECT 'VD-' || substr(sha256(CASE WHEN coalesce("_id", '') = '' THEN {_JSON} ELSE "_id" END), 1, 20) AS record_id,
  substr(sha256(concat_ws('|', coalesce(lodged::VARCHAR, ''), coalesce(decided::VARCHAR, ''), education_level, submit_location, includes_partner, is_diy, field_of_study_group)), 1, 20) AS duplicate_key,
  'PLAT-VISADASHBOARD' AS source_id, 'C' AS source_quality_tier, snap AS snapshot_date, '500' AS visa_subclass, CASE WHEN event = 1 THEN 'granted' ELSE 'pending' END AS application_status, event::BIGINT AS event_observed,
  lodged AS lodgement_date, CASE WHEN event = 1 THEN decided END AS decision_date, until AS as_of_date, waiting::BIGINT AS waiting_days, education_level, study_sector, field_of_study_group, submit_location, includes_partner, is_diy, provider_group,
  greatest(0, 100 - {' - '.join(f'(CASE WHEN wrong[{i + 1}] THEN {p} ELSE 0 END)' for i, (_, p) in enumerate(PENALTIES))})::BIGINT AS record_quality_score,
  concat_ws('|', {', '.join(f"CASE WHEN wrong[{i + 1}] THEN '{n}' END" for i, (n, _) in enumerate(PENALTIES))}) AS quality_flags, '' AS provenance_url FROM c)"""


def _normal(spark, folder):
    return longs(normalize_cases(v.raw_records(spark, folder), v.SNAPSHOT), "event_observed", "waiting_days", "record_quality_score")


@query(f"WITH {_NORMAL} SELECT * FROM normal")
def normalize_records(spark, folder):
    return _normal(spark, folder)


@query(f"WITH {_NORMAL} SELECT record_quality_score, count(*)::BIGINT AS cases FROM normal GROUP BY 1")
def case_quality_score(spark, folder):
    return _normal(spark, folder).groupBy("record_quality_score").agg(F.count("*").alias("cases"))


@query(f"WITH {_NORMAL} SELECT flag, count(*)::BIGINT AS row_count FROM (SELECT unnest(string_split(quality_flags, '|')) AS flag FROM normal) WHERE flag <> '' GROUP BY 1")
def flag_counts(spark, folder):
    return quality.flag_counts(_normal(spark, folder))


@query(f"WITH {_NORMAL} SELECT record_id, duplicate_key FROM normal")
def case_hash_keys(spark, folder):
    return _normal(spark, folder).select("record_id", "duplicate_key")


@query(f"WITH {_NORMAL} SELECT is_diy, includes_partner, count(*)::BIGINT AS cases FROM normal GROUP BY 1, 2")
def boolish_map(spark, folder):
    return _normal(spark, folder).groupBy("is_diy", "includes_partner").agg(F.count("*").alias("cases"))


@query(f"WITH {_NORMAL} SELECT field_of_study_group, provider_group, submit_location, education_level, count(*)::BIGINT AS cases FROM normal GROUP BY ALL")
def field_group_map(spark, folder):
    return _normal(spark, folder).groupBy("field_of_study_group", "provider_group", "submit_location", "education_level").agg(F.count("*").alias("cases"))


_DIMENSIONS = ["application_status", "education_level", "study_sector", "submit_location", "includes_partner", "is_diy", "provider_group", "field_of_study_group"]


@query(f"WITH {_NORMAL}, " + "p AS (" + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d}::VARCHAR AS value FROM normal" for d in _DIMENSIONS) + ") SELECT dimension, CASE WHEN coalesce(value, '') = '' THEN '(blank)' ELSE value END AS value, count(*)::BIGINT AS row_count FROM p GROUP BY 1, 2")
def profile_counts(spark, folder):
    return quality.value_counts(_normal(spark, folder), _DIMENSIONS)


@query("SELECT url, CASE WHEN contains(h, 'xiaohongshu') OR contains(h, 'xhslink') THEN 'Xiaohongshu' WHEN contains(h, 'weibo') THEN 'Weibo' WHEN ends_with(h, 'x.com') OR contains(h, 'twitter.com') THEN 'X' WHEN contains(h, 'reddit.com') THEN 'Reddit' ELSE 'PublicWeb' END AS platform FROM (SELECT url, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS h FROM (SELECT replace(replace(replace(url, 'example.org', 'www.reddit.com'), 'example.net', 'x.com'), 'blog.', 'weibo.') AS url FROM pages))")
def platform_from_url(spark, folder):
    urls = read_table(spark, folder, "pages").select(F.replace(F.replace(F.replace("url", F.lit("example.org"), F.lit("www.reddit.com")), F.lit("example.net"), F.lit("x.com")), F.lit("blog."), F.lit("weibo.")).alias("url"))
    return urls.select("url", rules.platform(F.col("url")).alias("platform"))


_STREAMS = "CASE WHEN study_sector IN (" + ", ".join(f"'{s}'" for s in rules.SECTORS_WITH_STREAM) + ") THEN study_sector || ' Sector' ELSE study_sector END"


@query(f"WITH {_NORMAL} SELECT {_STREAMS} AS stream, count(*)::BIGINT AS cases, round(count(*) / (SELECT count(*) FROM normal), 4) AS share FROM normal GROUP BY 1")
def stream_for_sector(spark, folder):
    counts = _normal(spark, folder).groupBy(rules.stream_for_sector(F.col("study_sector")).alias("stream")).agg(F.count("*").alias("cases"))
    return counts.join(F.broadcast(counts.agg(F.sum("cases").alias("n")))).select("stream", "cases", rules.percentage(F.col("cases"), F.col("n")).alias("share"))


@query("SELECT fy, m::BIGINT AS m, strftime(make_date(substr(fy, 1, 4)::INT, 7, 1) + to_months(m::INT - 1), '%Y-%m') AS activity_month FROM (SELECT DISTINCT (year(o_orderdate)) || '-' || right((year(o_orderdate) + 1)::VARCHAR, 2) AS fy FROM orders), range(1, 13) r(m)")
def fy_month_map(spark, folder):
    year = F.year("o_orderdate")
    years = read_table(spark, folder, "orders").select(F.concat_ws("-", year, F.substring((year + 1).cast("string"), 3, 2)).alias("fy")).distinct()
    return years.withColumn("m", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long")))).withColumn("activity_month", rules.calendar_month(F.col("fy"), F.col("m")))
