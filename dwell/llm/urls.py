"""URL rules matched by host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm.common import ascii_lower, checkpointed

#: Rules above this many are joined by shuffle, not broadcast.
BROADCAST_RULES = 100_000


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of ``pages`` (page_id, url).

    host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from
    there up to ``?``, ``#`` or the end. ``rules`` (verdict, host, path): a rule fits its host and all
    subdomains if the path starts with the rule's. The longest fitting rule wins (by length of host and
    path, then by text, then block before allow); without one the verdict is ``default``.

    Each distinct (host, path) is expanded to its host suffixes times those path prefixes whose length
    some rule has. Expressions meet rules on the first 32 bits of their SHA-256 and are confirmed by
    the whole digest. Expansion is of distinct addresses, so an address of very many pages counts once;
    their verdicts are materialised and joined back, so that its pages can be split over tasks.

    A null url or one without ``://``: host and path empty, no rule. Empty rule hosts, null hosts or
    verdicts fit nothing; a null rule path counts as empty. Repeated rules and rows are harmless; an
    empty rule table leaves the default. Other columns are ignored.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    after = F.expr("substring(coalesce(url, ''), locate('://', coalesce(url, '')) + 3)")
    after = F.when(F.locate("://", url) > 0, after).otherwise("")
    rest = F.substring_index(F.substring_index(after, "#", 1), "?", 1)
    host = ascii_lower(F.substring_index(rest, "/", 1))
    split = pages.select("page_id", rest.alias("rest"), host.alias("host"))
    split = split.select("page_id", "host", F.expr("substring(rest, length(host) + 1)").alias("path"))

    rules = rules.select(F.col("verdict"), ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    rules = rules.where("verdict is not null and host <> ''").distinct()
    expression = lambda h, p: F.concat(h, F.lit("\n"), p)
    rules = rules.select("verdict", F.concat("host", "path").alias("rule"), F.length("path").alias("size"), F.sha2(expression(F.col("host"), F.col("path")), 256).alias("digest"))
    sizes = rules.agg(F.array_sort(F.collect_set("size")).alias("sizes"), F.count("*").alias("n")).first()
    marked = rules.select("verdict", "rule", F.col("digest").alias("rule_digest"), F.substring("digest", 1, 8).alias("short"))
    if sizes.n <= BROADCAST_RULES:
        marked = F.broadcast(marked)

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_distinct(F.transform(F.array(*[F.lit(n) for n in sizes.sizes]).cast("array<int>"), lambda n: F.substring(F.col("path"), F.lit(1), n)))
    pairs = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.sha2(expression(h, p), 256))))
    address = split.where("host <> ''").select("host", "path").distinct()
    asked = address.select("host", "path", F.explode(pairs).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    met = asked.join(marked, "short").where("digest = rule_digest")
    rank = F.struct(F.length("rule"), F.col("rule"), (F.col("verdict") == "block"), F.col("verdict"))
    best = checkpointed(met.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best")))
    # pages without a host meet nothing and needn't meet in one task
    spread = F.when(F.col("host") == "", F.concat(F.lit("\n"), F.xxhash64("page_id").cast("string"))).otherwise(F.col("host"))
    best = best.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "best")
    judged = split.withColumn("_spread", spread).join(best, (F.col("_spread") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: The fixed rules of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: The same rows for DuckDB under RULES.
SQL = """
WITH r(verdict, host, path) AS (VALUES ('allow','org','/'), ('block','example.org','/es/'), ('block','example.org','/en/1'), ('allow','com','/fr/'), ('block','com','/de/')),
a AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/]*') AS raw, rest FROM a),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(raw) + 1) AS path FROM b),
u AS (SELECT DISTINCT host, path FROM p),
m AS (SELECT u.host, u.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
      FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""
