"""Bulk metadata pages: errors, continuation tokens, records and their version history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwatch import schemas

TEXT_FIELDS = [
    "id", "submitter", "authors", "title", "comments", "journal-ref", "doi", "abstract", "report-no",
]  # fixed values: leaf elements of a record
XML_OPTIONS = {"ignoreSurroundingSpaces": "false"}


def _ref(name: str) -> Column:
    return F.col(f"`{name}`")


def parse_pages(pages: DataFrame, xml: str = "xml") -> DataFrame:
    """Parse each page once; adds ``page`` (error, records, token) to the page's other columns.

    A page that cannot be parsed to its end counts as broken as a whole (``page_rejects``).

    The parsed page is exploded out of a one-element array.  A plain projection would be copied into
    every filter on the page's fields, and each copy would parse the XML again.
    """
    parsed = F.array(F.from_xml(F.col(xml), schemas.RECORD_PAGE, XML_OPTIONS))
    return pages.withColumn("page", F.explode(parsed)).drop(xml)


def page_errors(parsed: DataFrame) -> DataFrame:
    """Pages on which the service reported an error, with its text."""
    rejected = parsed.where(F.col("page.error").isNotNull())
    return rejected.withColumn("error", F.coalesce(F.col("page.error._VALUE"), F.lit(""))).drop("page")


def _broken() -> Column:
    """A page that is neither an error page nor a page of records: cut off, or another document."""
    return F.col("page.error").isNull() & F.col("page.ListRecords").isNull()


def page_rejects(parsed: DataFrame) -> DataFrame:
    """Pages that are neither error pages nor pages of records; none of their records can be read."""
    return parsed.where(_broken()).drop("page")


def fail_on_error(parsed: DataFrame) -> DataFrame:
    """The strict form: the job fails on the first error page or broken page."""
    told = F.concat(F.lit("service returned error: "), F.coalesce(F.col("page.error._VALUE"), F.lit("")))
    message = F.when(_broken(), F.lit("page is neither an error nor records")).otherwise(told)
    bad = F.col("page.error").isNotNull() | _broken()
    return parsed.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))


def page_tokens(parsed: DataFrame) -> DataFrame:
    token = F.coalesce(F.col("page.ListRecords.resumptionToken._VALUE"), F.lit(""))
    return parsed.withColumn("token", token).drop("page")


def page_records(parsed: DataFrame) -> DataFrame:
    """Raw records of error-free pages, one row each, in page order (``record_pos``)."""
    good = parsed.where(F.col("page.error").isNull())
    keep = [c for c in parsed.columns if c != "page"]
    rows = good.select(*keep, F.posexplode("page.ListRecords.record").alias("record_pos", "record"))
    raw = rows.where(F.col("record.metadata.arXivRaw").isNotNull())
    return raw.select(*keep, "record_pos", "record.metadata.arXivRaw.*")


def _listed(values: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(values, F.array().cast(kind))


def flatten_records(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Nine nullable text columns and the category, version and date lists."""
    version = F.col("version")
    dates = F.flatten(F.transform(version, lambda v: _listed(v["date"])))
    return raw.select(
        *(keep or []),
        *(_ref(name) for name in TEXT_FIELDS),
        _listed(F.col("categories")).alias("categories"),
        _listed(F.transform(version, lambda v: v["_version"])).alias("versions"),
        _listed(dates).alias("versions_dates"),
    )


def version_history(records: DataFrame) -> DataFrame:
    """One row per version of a record; ``is_latest`` marks the last one."""
    steps = F.arrays_zip(F.col("versions").alias("version"), F.col("versions_dates").alias("date"))
    rows = records.select("id", F.size("versions").alias("n"), F.posexplode(steps).alias("pos", "step"))
    return rows.select(
        "id",
        F.col("pos").alias("version_pos"),
        F.col("step.version").alias("version"),
        F.col("step.date").alias("version_date"),
        (F.col("pos") == F.col("n") - 1).alias("is_latest"),
    )
