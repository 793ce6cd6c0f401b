"""python -m dwell.cli COMMAND: the pipeline's commands on one Spark session."""

from __future__ import annotations

import argparse
import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.functions.records import RAW, normalize_cases
from dwell.functions.rules import platform
from dwell.functions.social import normalize_posts, page_text
from dwell.operators import quality
from dwell.plans import anchors, charts, jobs
from dwell.sources import files, pivots, web

PREDICTORS = {"education_level": "PhD", "study_sector": "Postgraduate Research", "submit_location": "Outside Australia", "includes_partner": "unknown", "is_diy": "unknown", "provider_group": "Unknown", "field_of_study_group": "Unknown"}
#: The search endpoint and the query of the cursor API.
SEARCH_URL, SEARCH = "https://api.x.com/2/tweets/search/recent", '("subclass 500" OR "澳洲学签") (lodged OR granted OR 递签 OR 下签) -is:retweet'


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="dwell")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *needed: str, **given) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for n in needed:
            s.add_argument(f"--{n}", required=True)
        for n, value in given.items():
            s.add_argument("--" + n.replace("_", "-"), default=value, type=type(value) if isinstance(value, int) else str)
        return s

    command("collect", "url", "output", "snapshot", page_size=100, max_pages=0).add_argument("--ignore-robots", action="store_true")
    command("validate", "cases")
    command("profile", "cases", "output")
    command("predict", "cases", education=None, location=None)
    command("audit", "cases", "output", markdown=None)
    command("train", "cases", "flows", "output")
    command("train-anchors", "cases", "anchors", "output")
    s = command("forecast", "lodged-at", as_of=None, timezone="Asia/Shanghai", model=None, flows=None, cases=None, anchors=None, **PREDICTORS)
    s.add_argument("--engine", choices=["deployed", "anchor"], default="deployed")
    s = command("social-collect", "output", "collected", urls=None, query=SEARCH, max_pages=3, url=SEARCH_URL)
    s.add_argument("source", choices=["urls", "x"], nargs="?", default="urls")
    s.add_argument("--ignore-robots", action="store_true")
    command("official-refresh", "output", "detected-at", "first", "last", lodged=None, granted=None, package=None)
    command("visualize", "cases", "output", model=None)
    return p


def collect(spark: SparkSession, a) -> dict:
    """Case rows of a paged source, the first of each record id in the order of the pages."""
    reader = spark.read.format("json_records").option("url", a.url).option("size", a.page_size).option("robots", str(not a.ignore_robots).lower())
    records = (reader.option("most", a.max_pages) if a.max_pages else reader).load()
    raw = records.select(F.from_json("record", ", ".join(f"`{n}` string" for n in RAW)).alias("r")).select("r.*")
    # the source is one partition, so the number follows the pages
    numbered = normalize_cases(raw, a.snapshot, a.url).withColumn("line_no", F.monotonically_increasing_id()).cache()
    kept = quality.first_seen(numbered, "record_id", "line_no").drop("line_no")
    kept.write.mode("overwrite").csv(a.output, header=True)
    return {"rows_read": numbered.count(), "rows_written": kept.count(), "output": a.output}


def found_posts(spark: SparkSession, a) -> DataFrame:
    """Posts (platform, source_url, text, published_at) of public pages, or of a search by cursor."""
    reader = spark.read.format("json_records").option("robots", str(not a.ignore_robots and a.source == "urls").lower())
    if a.source == "x":
        params = json.dumps({"query": a.query, "max_results": 100, "tweet.fields": "created_at,lang"})
        records = reader.option("style", "cursor").option("url", a.url).option("params", params).option("most", a.max_pages).option("delay", 1.0).load()
        r = records.select(F.from_json("record", "id string, text string, created_at string").alias("r")).select("r.*")
        return r.select(F.lit("X").alias("platform"), F.concat(F.lit("https://x.com/i/web/status/"), F.coalesce("id", F.lit(""))).alias("source_url"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("created_at", F.lit("")).alias("published_at"))
    urls = "\n".join(r.value for r in spark.read.text(a.urls).collect())  # a list made by hand
    pages = reader.option("style", "pages").option("urls", urls).load().select(F.from_json("record", "url string, html string").alias("r")).select("r.*")
    return pages.withColumn("t", page_text("html")).select(platform(F.col("url")).alias("platform"), F.col("url").alias("source_url"), F.col("t.text").alias("text"), F.col("t.published").alias("published_at"))


def official_refresh(spark: SparkSession, a) -> dict:
    """Publish the flows of two workbooks, given or looked up in the package and copied beside the output."""
    if bool(a.lodged) != bool(a.granted):
        raise ValueError("give both workbooks or neither")
    books, told = {"lodged": a.lodged, "granted": a.granted}, {"lodged": {}, "granted": {}}
    if not a.lodged:
        told = web.package_resources(web.Client(robots=False).object, a.package)
        for kind in books:
            books[kind] = f"{a.output}/workbooks/{kind}.xlsx"
            web.download(spark, told[kind]["url"], books[kind])
    parts = [pivots.monthly_flows(pivots.read_pivots(spark, books[k]), k, told[k], a.first) for k in ("lodged", "granted")]
    return {"revisions": jobs.refresh(spark, parts[0].unionByName(parts[1]), a.output, a.detected_at, a.first, a.last), "resources": told}


def forecast(spark: SparkSession, a) -> dict:
    asked = {c: getattr(a, c) for c in PREDICTORS}
    lodged = jobs.parse_instant(a.lodged_at, a.timezone)
    now = jobs.parse_instant(a.as_of, a.timezone) if a.as_of else datetime.now(lodged.tzinfo)
    state = files.read_artifact(spark, a.model) if a.model else None
    if a.engine == "anchor":
        return anchors.forecast(spark, jobs.observations(spark, a.cases), anchors.load_anchors(spark, a.anchors), lodged, now, asked, state)
    if state is None:
        raise ValueError("the deployed engine needs --model")
    return jobs.forecast(spark, state, [asked | {"lodged_at": a.lodged_at, "as_of": now.isoformat()}], a.flows or "", a.timezone)[0]


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("dwell").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command in ("collect", "social-collect"):
        web.register(spark)
    if a.command == "collect":
        found = collect(spark, a)
    elif a.command == "profile":
        rows = jobs.profile(spark, a.cases)
        rows.write.mode("overwrite").csv(a.output, header=True)
        found = {"rows": rows.count(), "output": a.output}
    elif a.command == "audit":
        found = jobs.audit(spark, a.cases)
        files.write_artifact(spark, a.output, found)
        if a.markdown:
            files.write_text(spark, a.markdown, jobs.audit_markdown(found))
    elif a.command == "train":
        state = jobs.train(spark, a.cases, a.flows, a.output, least=(100, 50, 50))
        found = {k: state[k] for k in ("ranking", "selected_baseline", "deployment_holdout_evaluation", "confidence")}
    elif a.command == "train-anchors":
        found = anchors.train_anchor_model(spark, jobs.observations(spark, a.cases), anchors.load_anchors(spark, a.anchors), a.output)
    elif a.command == "forecast":
        found = forecast(spark, a)
    elif a.command == "social-collect":
        table = files.upsert_table(normalize_posts(found_posts(spark, a), a.collected), a.output, ["evidence_id"])
        found = {"rows": table.count(), "output": a.output}
    elif a.command == "official-refresh":
        found = official_refresh(spark, a)
    elif a.command == "visualize":
        found = charts.write_tables(spark, a.cases, a.output, files.read_artifact(spark, a.model) if a.model else None)
    elif a.command == "validate":
        found = jobs.validate(spark, a.cases)
    else:
        found = jobs.predict(spark, a.cases, a.education, a.location)
    print(json.dumps(found, ensure_ascii=False, sort_keys=True, default=str))


if __name__ == "__main__":
    main()
