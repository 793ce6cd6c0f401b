"""Monthly counts from the pivot cache of spreadsheet files."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.functions.rules import calendar_month

_SPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: The cells that are counted.
WANTED = {"Sector": "Postgraduate Research Sector", "Applicant Type": "Primary", "Citizenship Country": "China, Peoples Republic of (excl SARs)", "Client Location": "Outside Australia"}


def pivot_records(content: bytes, wanted: dict[str, str]):
    """Decoded cells of the records whose coded cells stand for ``wanted``, read as a stream."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        fields = ElementTree.fromstring(book.read("xl/pivotCache/pivotCacheDefinition1.xml")).find(f"{_SPACE}cacheFields")
        if fields is None:
            raise ValueError("the workbook has no pivot cache fields")
        names = [f.get("name", "") for f in fields]
        shared = [[x.get("v") for x in f.iterfind(f"{_SPACE}sharedItems/*")] for f in fields]
        codes = {names.index(n): str(shared[names.index(n)].index(v)) for n, v in wanted.items()}
        with book.open("xl/pivotCache/pivotCacheRecords1.xml") as stream:
            for _, node in ElementTree.iterparse(stream):
                if node.tag == f"{_SPACE}r":
                    cells = [c.get("v") for c in node]
                    if all(cells[i] == c for i, c in codes.items()):
                        yield {n: shared[i][int(cells[i])] if node[i].tag == f"{_SPACE}x" else cells[i] for i, n in enumerate(names)}
                    node.clear()


def read_pivots(spark: SparkSession, path: str, wanted: dict[str, str] | None = None) -> DataFrame:
    """(path, sha256, fiscal_year, month, total) of the wanted records of workbooks."""
    wanted = WANTED if wanted is None else wanted

    def run(parts):
        for part in parts:
            for place, content in zip(part["path"], part["content"]):
                rows = [(place, next(v for k, v in r.items() if k.startswith("Financial Year of Visa")), r["Month"], float(r["Total"] or 0)) for r in pivot_records(bytes(content), wanted)]
                yield pd.DataFrame(rows, columns=["path", "fiscal_year", "month", "total"])

    books = spark.read.format("binaryFile").load(path)
    cells = books.select("path", "content").mapInPandas(run, "path string, fiscal_year string, month string, total double")
    return cells.join(books.select("path", F.sha2("content", 256).alias("sha256")), "path")


def snapshot_date(fiscal_year: Column, name: Column) -> Column:
    """The last date that fiscal years are said to reach, else the date in the resource's name (an aggregate)."""
    reach = F.try_to_date(F.regexp_extract(fiscal_year, r"to\s+(\d{1,2}\s+[A-Za-z]+\s+\d{4})", 1), "d MMMM yyyy")
    reach = F.when(fiscal_year.rlike(r"to\s+\d{1,2}\s+[A-Za-z]+\s+\d{4}"), reach)
    return F.coalesce(F.max(reach), F.max(F.try_to_date(F.regexp_extract(name, r"at\s+(\d{4}-\d{2}-\d{2})", 1))))


def snapshot_of(cells: DataFrame, name: str = "path") -> str:
    """The snapshot date of read_pivots rows as text; an error if neither cells nor names give one."""
    day = cells.agg(snapshot_date(F.col("fiscal_year"), F.col(name)).alias("day")).first()["day"]
    if day is None:
        raise ValueError("the workbook doesn't say how far its numbers reach")
    return str(day)


#: What a published flow says of itself.
LINEAGE = {"applicant_type": "Primary", "client_location": "Outside Australia", "citizenship_country": "China, Peoples Republic of (excl SARs)", "sector": "Postgraduate Research Sector", "extraction_method": "pivot cache records"}


def monthly_flows(cells: DataFrame, activity: str, resource: dict[str, str], first: str = "2015-01") -> DataFrame:
    """The published rows of one workbook: its monthly totals up to its snapshot, with their lineage."""
    day = snapshot_of(cells)
    sha = F.lit(cells.agg(F.max("sha256").alias("s")).first()["s"])
    told = {n: F.lit(x) for n, x in LINEAGE.items()} | {"source_resource_id": F.lit(resource.get("resource_id", "")), "source_last_modified": F.lit(resource.get("last_modified", "")), "source_url": F.lit(resource.get("url", "")), "source_file_sha256": sha}
    return monthly_totals(cells, first, day[:7]).withColumns({"activity_type": F.lit(activity), "source_snapshot_date": F.lit(day)} | told)


def monthly_totals(cells: DataFrame, first: str = "2015-01", last: str | None = None) -> DataFrame:
    """(activity_month, count): whole numbers summed for calendar months from ``first`` to ``last``."""
    number = F.regexp_extract("month", r"(\d+)", 1).cast("int")
    month = calendar_month(F.regexp_extract("fiscal_year", r"(\d{4}-\d{2})", 1), number)
    sums = cells.groupBy(month.alias("activity_month")).agg(F.sum(F.col("total").cast("long")).alias("count"))
    return sums.where((F.col("activity_month") >= first) & (F.lit(True) if last is None else F.col("activity_month") <= last))
