"""Revision years, amendments and what they say of a record's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procmatch.functions.text import once

UNKNOWN, ACTIVE = "Unknown Designation", "Active (DEMO / SAMPLE DATA)"
STATES = {"gone": "Superseded", "amended": "Active — amendments recorded in corpus", "latest": "Active — latest known revision in corpus", "none": "Revision information unavailable"}


def whole_number(c: Column) -> Column:
    """Text as an integer; of a decimal number the whole part; else null."""
    return F.coalesce(c.try_cast("int"), c.try_cast("double").try_cast("int"))


def amendments(items: Column) -> Column:
    """Amendments from text items: those that aren't objects go; latest year first, then highest number, then as listed."""
    objects = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.startswith(F.ltrim(x), F.lit("{")))

    def entry(i: Column, number: Column, year: Column, title: Column) -> Column:
        named = F.when((number.isNotNull()) & (number != 0), number.cast("string")).otherwise("Unnumbered")
        said = F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Amendment No. "), named))
        return F.struct((-F.coalesce(year, F.lit(0))).alias("_y"), (-F.coalesce(number, F.lit(0))).alias("_n"), i.alias("_i"), number.alias("amendment_number"), year.alias("year"), said.alias("title"))

    def one(x: Column, i: Column) -> Column:
        read = lambda j: F.struct(whole_number(j["amendment_number"]).alias("number"), whole_number(j["year"]).alias("year"), j["title"].alias("title"))
        return once(once(F.from_json(x, "amendment_number STRING, year STRING, title STRING"), read), lambda a: entry(i, a["number"], a["year"], a["title"]))

    return F.transform(F.array_sort(F.transform(objects, one)), lambda x: F.struct(x["amendment_number"].alias("amendment_number"), x["year"].alias("year"), x["title"].alias("title")))


def add_versions(records: DataFrame, items: str = "amendments", keep_as: str = "amendment_history") -> DataFrame:
    """``records`` with the sorted history, its count and latest entry, version status and a summary.

    The history is exploded from a list of one, so that filters on what is made of it stay above it and don't parse it again for each mention.
    """
    year = whole_number(F.col("revision_year").cast("string"))
    df = records.drop(keep_as).select("*", F.explode(F.array(amendments(F.col(items)))).alias(keep_as))
    count, first = F.size(keep_as), F.get(keep_as, F.lit(0))
    status = F.lower(F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit(ACTIVE)))
    state = F.when(F.contains(status, F.lit("superseded")) | F.contains(status, F.lit("withdrawn")), STATES["gone"]).when(year.isNotNull() & (count > 0), STATES["amended"]).when(year.isNotNull(), STATES["latest"]).otherwise(STATES["none"])
    df = df.withColumns({"revision_year": year, "amendment_count": count.cast("long"), "has_amendments": count > 0, "latest_number": first["amendment_number"], "latest_year": first["year"], "version_status": state})
    known = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.col(c).cast("string")).otherwise("N/A")
    latest = F.when((known("latest_number") != "N/A") | (known("latest_year") != "N/A"), F.concat(F.lit(" (Latest: Amd. #"), known("latest_number"), F.lit(", "), known("latest_year"), F.lit(")"))).otherwise("")
    designation = F.coalesce(F.nullif(F.col("is_number"), F.lit("")), F.lit(UNKNOWN))
    summary = (
        F.when(F.col("version_status") == STATES["gone"], F.concat(designation, F.lit(" status is recorded as Superseded in the available corpus. Verification required.")))
        .when(F.col("version_status") == STATES["amended"], F.concat(F.col("revision_year").cast("string"), F.lit(" revision with "), F.col("amendment_count").cast("string"), F.lit(" amendment(s) recorded in the available corpus"), latest, F.lit(".")))
        .when(F.col("version_status") == STATES["latest"], F.concat(F.col("revision_year").cast("string"), F.lit(" revision with no active amendments recorded in the available demo corpus.")))
        .otherwise("Revision year metadata unavailable in the demo corpus. Authoritative verification required.")
    )
    return df.withColumn("version_summary", summary)


def overview(versions: DataFrame) -> DataFrame:
    """One row: records, and those with amendments."""
    return versions.agg(F.count("*").alias("total_standards"), F.count_if("has_amendments").alias("standards_with_amendments"))


def search(versions: DataFrame, text: str, history: str = "amendment_history") -> DataFrame:
    """Records whose designation, summary, state or an amendment holds the text, whatever its case."""
    q = F.lit(text.lower().strip())
    holds = lambda c: F.contains(F.lower(F.coalesce(c.cast("string"), F.lit(""))), q)
    return versions.where(holds(F.col("is_number")) | holds(F.col("version_summary")) | holds(F.col("version_status")) | F.exists(history, lambda a: holds(a["title"]) | holds(a["year"]) | holds(a["amendment_number"])))
