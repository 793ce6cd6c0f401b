"""Normalisation of raw case records into the 22 columns of a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.functions import rules

RAW = ["_id", "submitTime", "getVisaTime", "ifGetVisa", "educationLevel", "submitPlace", "ifIncludedCouple", "ifDIY", "major", "schoolType"]
#: Flag, points off: fixed values, in the order in which flags are listed.
PENALTIES = (
    ("missing_lodgement_date", 55), ("granted_without_decision_date", 30), ("decision_before_lodgement", 60), ("future_lodgement", 60),
    ("implausible_waiting_days", 50), ("unknown_education_level", 8), ("unknown_submit_location", 5), ("missing_source_record_id", 5),
)


def normalize_cases(raw: DataFrame, snapshot: str, url: str = "") -> DataFrame:
    """One case for each raw record; officer codes, free text and source ids don't pass.

    ``raw`` has the columns RAW, all text; a missing one counts as null.
    """
    for name in RAW:
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    snap = F.lit(snapshot).cast("date")
    c = raw.select(
        *RAW,
        rules.iso_date(F.col("submitTime")).alias("lodged"), rules.iso_date(F.col("getVisaTime")).alias("decided"), (rules.boolish(F.col("ifGetVisa")) == "yes").alias("claimed"),
        rules.education_level(F.col("educationLevel")).alias("education_level"), rules.study_sector(F.col("educationLevel")).alias("study_sector"),
        rules.field_group(F.col("major")).alias("field_of_study_group"), rules.location(F.col("submitPlace")).alias("submit_location"),
        rules.partner(F.col("ifIncludedCouple")).alias("includes_partner"), rules.boolish(F.col("ifDIY")).alias("is_diy"), rules.provider_group(F.col("schoolType")).alias("provider_group"),
    )
    c = c.withColumn("event", F.col("claimed") & F.col("decided").isNotNull())
    c = c.withColumn("until", F.when(F.col("event"), F.col("decided")).otherwise(snap)).withColumn("waiting", F.datediff("until", "lodged"))
    has_id = F.coalesce(F.col("_id"), F.lit("")) != ""
    wrong: dict[str, Column] = {
        "missing_lodgement_date": F.col("lodged").isNull(),
        "granted_without_decision_date": F.col("claimed") & F.col("decided").isNull(),
        "decision_before_lodgement": F.col("decided") < F.col("lodged"),
        "future_lodgement": F.col("lodged") > snap,
        "implausible_waiting_days": (F.col("waiting") < 0) | (F.col("waiting") > 3650),
        "unknown_education_level": F.col("education_level") == "Unknown",
        "unknown_submit_location": F.col("submit_location") == "Unknown",
        "missing_source_record_id": ~has_id,
    }
    flags = F.array_compact(F.array(*[F.when(wrong[name], F.lit(name)) for name, _ in PENALTIES]))
    lost = sum((F.when(wrong[name], points).otherwise(0) for name, points in PENALTIES), F.lit(0))
    text = lambda d: F.coalesce(F.col(d).cast("string"), F.lit(""))
    key = F.concat_ws("|", text("lodged"), text("decided"), *["education_level", "submit_location", "includes_partner", "is_diy", "field_of_study_group"])
    source = F.when(has_id, F.col("_id")).otherwise(rules.json_text(RAW))
    return c.select(
        F.concat(F.lit("VD-"), F.substring(F.sha2(source, 256), 1, 20)).alias("record_id"), F.substring(F.sha2(key, 256), 1, 20).alias("duplicate_key"),
        F.lit("PLAT-VISADASHBOARD").alias("source_id"), F.lit("C").alias("source_quality_tier"), snap.alias("snapshot_date"), F.lit("500").alias("visa_subclass"),
        F.when(F.col("event"), "granted").otherwise("pending").alias("application_status"), F.col("event").cast("int").alias("event_observed"), F.col("lodged").alias("lodgement_date"),
        F.when(F.col("event"), F.col("decided")).alias("decision_date"), F.col("until").alias("as_of_date"), F.col("waiting").alias("waiting_days"),
        "education_level", "study_sector", "field_of_study_group", "submit_location", "includes_partner", "is_diy", "provider_group",
        F.greatest(F.lit(0), F.lit(100) - lost).alias("record_quality_score"), F.array_join(flags, "|").alias("quality_flags"), F.lit(url).alias("provenance_url"),
    )
