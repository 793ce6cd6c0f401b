"""The case model over the star-schema tables, as DataFrames and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.sources.tables import read_table

SNAPSHOT, CUTOFF, CALIBRATION_END, TEST_END = "2001-12-31", "1999-12-31", "2000-08-31", "2001-04-30"
HORIZONS = (90, 180, 365)

QUALITY = "100 - CASE WHEN o_totalprice < 50000 THEN 45 ELSE 0 END - CASE WHEN o_orderstatus = 'P' THEN 20 ELSE 0 END - CASE WHEN c_acctbal < 0 THEN 10 ELSE 0 END"
TIER = "CASE r_name WHEN 'AFRICA' THEN 'A' WHEN 'AMERICA' THEN 'B' WHEN 'ASIA' THEN 'B-C' WHEN 'EUROPE' THEN 'C' ELSE 'D' END"


def cases(spark: SparkSession, folder: str, people: bool = True) -> DataFrame:
    """One case for each order: lodged at the order date, decided at the first shipping date from then on.

    Without ``people`` only dates and durations, and the customers aren't read.
    """
    t = lambda n: read_table(spark, folder, n)
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.to_date("o_orderdate").alias("lodged"))
    shipped = t("lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("shipped"))
    # orders and line items meet once; the aggregate needs no further shuffle
    orders = orders if people else orders.select("o_orderkey", "lodged", "o_totalprice")
    meet = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("shipped") >= F.col("lodged"))
    dated = orders.join(shipped, meet, "left").groupBy(*orders.columns).agg(F.min("shipped").alias("decided"))
    until = F.coalesce("decided", F.lit(SNAPSHOT).cast("date"))
    dates = ["lodged", "decided", until.alias("as_of"), F.col("decided").isNotNull().cast("int").alias("event"), F.datediff(until, "lodged").alias("days")]
    if not people:
        return dated.select(F.col("o_orderkey").alias("case_id"), *dates, F.col("o_totalprice").alias("price"))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    people = t("customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
    whole = dated.join(people, F.col("o_custkey") == F.col("c_custkey"))
    c = whole.select(
        F.col("o_orderkey").alias("case_id"), *dates,
        F.col("c_mktsegment").alias("segment"), F.col("o_orderpriority").alias("priority"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"),
        F.expr(QUALITY).alias("quality"), F.expr(TIER).alias("tier"), F.col("o_totalprice").alias("price"),
    )
    month = lambda d: F.coalesce(F.date_format(d, "yyyy-MM"), F.lit(""))
    return c.withColumn("dup", F.substring(F.sha2(F.concat_ws("|", month("lodged"), month("decided"), "segment", "priority"), 256), 1, 20))


CASES = f"""
d AS (SELECT o_orderkey, min(l_shipdate::DATE) AS decided FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate::DATE >= o_orderdate::DATE GROUP BY 1),
cases AS (
  SELECT o.o_orderkey AS case_id, o_orderdate::DATE AS lodged, decided, coalesce(decided, DATE '{SNAPSHOT}') AS as_of, (decided IS NOT NULL)::INT AS event,
    (coalesce(decided, DATE '{SNAPSHOT}') - o_orderdate::DATE)::INT AS days, c_mktsegment AS segment, o_orderpriority AS priority, r_name AS region, n_name AS nation,
    ({QUALITY})::INT AS quality, {TIER} AS tier, o_totalprice AS price,
    substr(sha256(concat_ws('|', strftime(o_orderdate, '%Y-%m'), coalesce(strftime(decided, '%Y-%m'), ''), c_mktsegment, o_orderpriority)), 1, 20) AS dup
  FROM orders o LEFT JOIN d ON o.o_orderkey = d.o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

#: Raw text records over orders; the same expressions run in both engines.
RAW = {
    "_id": "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE concat('r', o_orderkey) END",
    "submitTime": "CASE WHEN o_orderkey % 50 = 0 THEN 'soon' ELSE concat(cast(cast(o_orderdate AS DATE) AS VARCHAR(20)), 'T10:00') END",
    "getVisaTime": "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE cast(cast(first_ship AS DATE) AS VARCHAR(20)) END",
    "ifGetVisa": "CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' ELSE ' 是' END",
    "educationLevel": "CASE o_orderkey % 8 WHEN 0 THEN '博士' WHEN 1 THEN 'PhD candidate' WHEN 2 THEN '硕士研究生' WHEN 3 THEN 'Bachelor of Arts' WHEN 4 THEN 'High School' WHEN 5 THEN 'ELICOS' WHEN 6 THEN 'TAFE' ELSE NULL END",
    "submitPlace": "CASE o_orderkey % 5 WHEN 0 THEN '国内递交' WHEN 1 THEN 'Offshore' WHEN 2 THEN '澳洲境内' WHEN 3 THEN 'onshore' ELSE 'moon' END",
    "ifIncludedCouple": "CASE o_orderkey % 6 WHEN 0 THEN '单独学签' WHEN 1 THEN '携配偶' WHEN 2 THEN 'Partner' WHEN 3 THEN '1' WHEN 4 THEN 'No' ELSE NULL END",
    "ifDIY": "CASE o_orderkey % 4 WHEN 0 THEN 'DIY' WHEN 1 THEN '否' WHEN 2 THEN ' YES ' ELSE 'maybe' END",
    "major": "CASE o_orderkey % 10 WHEN 0 THEN '计算机科学' WHEN 1 THEN 'Nursing' WHEN 2 THEN 'Civil Engineering' WHEN 3 THEN 'Law' WHEN 4 THEN 'marketing' WHEN 5 THEN 'Physics' WHEN 6 THEN '商科' WHEN 7 THEN 'Teaching' WHEN 8 THEN 'Urban design' ELSE '' END",
    "schoolType": "CASE o_orderkey % 3 WHEN 0 THEN 'Monash  University' WHEN 1 THEN 'Western   Australia' ELSE NULL END",
}


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    ships = read_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"))
    orders = read_table(spark, folder, "orders").join(ships, F.col("l_orderkey") == F.col("o_orderkey"))
    return orders.selectExpr(*[f"{e} AS `{n}`" for n, e in RAW.items()])


RAW_SQL = "raw AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in RAW.items()) + " FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"


def dirty_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as untidy case rows: decided at the raw shipping date, event by line status."""
    items = read_table(spark, folder, "lineitem").join(read_table(spark, folder, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), F.col("l_orderkey") == F.col("o_orderkey"))
    return items.selectExpr(*[f"{e} AS {n}" for n, e in DIRTY.items()])


DIRTY = {
    "record_id": "concat(l_orderkey, '-', l_linenumber % 5)",
    "lodged": "cast(o_orderdate AS DATE)",
    "decided": "CASE WHEN l_linestatus = 'F' OR l_orderkey % 13 = 0 THEN cast(l_shipdate AS DATE) END",
    "snapshot": "DATE '2001-06-30'",
    "event": "CASE WHEN l_orderkey % 101 = 0 THEN 2 WHEN l_linestatus = 'F' THEN 1 ELSE 0 END",
    "status": "CASE WHEN l_linestatus = 'F' THEN 'granted' ELSE 'pending' END",
    "waiting": "CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE datediff(DAY, cast(o_orderdate AS DATE), CASE WHEN l_linestatus = 'F' THEN cast(l_shipdate AS DATE) ELSE DATE '2001-06-30' END) END",
    "quality": "CASE WHEN o_totalprice < 60000 THEN 30 ELSE 80 END",
    "mode": "CASE WHEN l_returnflag = 'R' THEN 'unknown' ELSE l_returnflag END",
    "band": "CASE WHEN l_quantity < 10 THEN '' WHEN l_quantity < 30 THEN 'Unknown' ELSE 'large' END",
}
DIRTY_SQL = "dirty AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in DIRTY.items()).replace("datediff(DAY,", "datediff('day',") + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def monthly_flows(spark: SparkSession, folder: str, part: str = "true") -> DataFrame:
    """(activity_month, activity_type, count) of lodgements and decisions."""
    c = cases(spark, folder, people=False).where(part)
    dated = c.select(F.explode(F.array(F.struct(F.lit("lodged").alias("activity_type"), F.col("lodged").alias("d")), F.struct(F.lit("granted").alias("activity_type"), F.col("decided").alias("d")))).alias("x"))
    return dated.where("x.d is not null").groupBy(F.date_format("x.d", "yyyy-MM").alias("activity_month"), F.col("x.activity_type").alias("activity_type")).agg(F.count("*").alias("count"))


def flows_sql(name: str, part: str = "true") -> str:
    return f"""{name} AS (SELECT strftime(x, '%Y-%m') AS activity_month, activity_type, count(*) AS "count" FROM (
      SELECT lodged AS x, 'lodged' AS activity_type FROM cases WHERE {part} UNION ALL SELECT decided, 'granted' FROM cases WHERE decided IS NOT NULL AND {part}) GROUP BY 1, 2)"""
