"""Removal of repeated runs of lines, found by winnowing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm.common import checkpointed, spark_words

#: Stands for a null doc_id in the order of documents.
_LAST = (1 << 63) - 1


def drop_repeated_lines(documents: DataFrame, run: int = 3, words: int | None = None) -> DataFrame:
    """``documents`` with the text of later repeats cut, and two more columns n_lines, n_removed.

    A line (text between line feeds, compared as it is) goes if a window of ``run`` lines of which one
    isn't blank covers it, and the same lines also start earlier: in a document of smaller doc_id, or
    earlier in the same one. Windows are judged on the input. With ``words``, a window of fewer than
    ``run`` lines that holds at least that many words counts as well.

    Each window picks its smallest line hash (the last of equal ones) as fingerprint, so equal windows
    pick the same line; fingerprints at one position only rule their windows out. Windows around the
    others are compared by content with the first place of each; consecutive ones make up the maximal
    repeats. First places are pre-aggregated, materialised and joined back, so a line of very many
    documents is one row of one side, and the other side can be split over tasks.

    Null or empty text: kept as it is, no lines. Rows that share a doc_id count as one document for the
    order, so equal rows don't cut each other; null doc_ids come after all others, as one document. A
    text of which every line goes becomes empty; no row is dropped. Other columns pass through, also
    under names used here.
    """
    names = documents.columns
    whole = documents.select(
        F.struct(*[documents[f"`{c}`"] for c in names]).alias("row"),
        F.coalesce(documents["doc_id"].cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(F.coalesce(documents["text"], F.lit(""))).alias("print"),
    )
    split = whole.where("row.text <> ''").select("doc", "print", F.split("row.text", "\n", -1).alias("lines"))
    full = lambda x: F.trim(F.translate(x, "\t\r\x0b\x0c", "    ")) != ""
    counts = [] if words is None else [F.transform("lines", lambda x: F.size(spark_words(x))).alias("words")]
    # texts are split and hashed once; windows are made of the hashes
    hashed = checkpointed(split.select("doc", "print", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", full).alias("full"), *counts))
    gone = _repeats(hashed, run)
    if words is not None:
        for size in range(1, run):
            gone = gone.union(_repeats(hashed, size, words))
        gone = gone.groupBy("doc", "print").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))

    lines = F.split("row.text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    judged = whole.join(gone, ["doc", "print"], "left")
    extra = [F.when(F.coalesce(F.col("row.text"), F.lit("")) == "", F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")]
    kept = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names if c not in ("n_lines", "n_removed")]
    return judged.select(*kept, *extra)


def _repeats(texts: DataFrame, run: int, words: int | None = None) -> DataFrame:
    """(doc, print, gone): the lines of each text that later repeats of windows of ``run`` lines cover.

    A window counts if it holds ``words`` words, or without ``words`` if a line of it isn't blank.
    """
    hashed = texts.where(F.size("h") >= run).select("doc", "print", "h", F.col("full" if words is None else "words").alias("full"))

    def window(s):
        part, held = F.slice("h", s + 1, run), F.slice("full", s + 1, run)
        least = F.array_min(part)
        return F.struct(
            s.alias("start"),
            F.element_at(part, 1).alias("head"),
            F.xxhash64(part).alias("key"),
            least.alias("mark"),
            (s + run - F.array_position(F.reverse(part), least).cast("int")).alias("mark_at"),
            (F.exists(held, lambda x: x) if words is None else F.aggregate(held, F.lit(0), lambda n, x: n + x) >= words).alias("some"),
        )

    windows = hashed.select("doc", "print", F.explode(F.transform(F.sequence(F.lit(0), F.size("h") - run), window)).alias("w")).where("w.some").select("doc", "print", "w.*")
    place = F.struct("doc", "mark_at")
    marks = windows.groupBy("mark").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("mark")
    marks = checkpointed(marks)
    met = windows.join(marks, "mark", "left_semi").select("doc", "print", "start", "head", "key")
    first = met.groupBy("key", "head").agg(F.min(F.struct("doc", "start")).alias("first"))
    first = checkpointed(first)
    later = met.join(first, ["key", "head"]).where(F.col("first") < F.struct("doc", "start"))
    gone = later.groupBy("doc", "print").agg(F.collect_set("start").alias("starts"))
    return gone.select("doc", "print", F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (run - 1))))).alias("gone"))


#: The same rows for DuckDB; ``{run}`` lines make a window.
SQL = """
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents WHERE text <> ''),
w AS (
  SELECT doc_id, pos AS start, list(line) OVER v AS part FROM l
  WINDOW v AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {run} - 1 FOLLOWING)),
v AS (SELECT * FROM w WHERE len(part) = {run} AND len(list_filter(part, lambda x: trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> '')) > 0),
f AS (SELECT *, min(struct_pack(d := doc_id, s := start)) OVER (PARTITION BY part) AS first FROM v),
g AS (SELECT DISTINCT doc_id, start + o AS pos FROM f, range({run}) r(o) WHERE first < struct_pack(d := doc_id, s := start)),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(kept, d.text) AS text
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
