"""Bulk metadata: landed pages to one flat table, with the site of the harvested set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwatch.functions import text as tx
from feedwatch.operators import records as rc


def metadata_table(pages: DataFrame, set_name: str | None = None, strict: bool = False) -> DataFrame:
    """Flat records of all good pages.

    Error pages and broken pages are skipped, or fail the job when ``strict``; ``page_errors`` and
    ``page_rejects`` list them.

    ``set_name`` names the page column holding the harvested set, from which the site is taken.
    """
    parsed = rc.parse_pages(pages)
    if strict:
        parsed = rc.fail_on_error(parsed)
    raw = rc.page_records(parsed)
    if set_name is None:
        return rc.flatten_records(raw)
    sited = raw.withColumn("site", tx.set_to_site(F.col(set_name)))
    return rc.flatten_records(sited, ["site"])
