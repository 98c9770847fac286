"""Journal digest: what is new in a feed since the last stored snapshot."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwatch.functions import formats as fmt
from feedwatch.functions import text as tx
from feedwatch.operators import novelty
from feedwatch.operators.digest import PER_PART, digest_concat
from feedwatch.plans.daily import digest_table
from feedwatch.session import durable
from feedwatch.sources.state import SeenLinks, write_digests


def entry_defaults(entries: DataFrame) -> DataFrame:
    return entries.withColumns(
        {n: F.coalesce(F.col(n), F.lit(v)) for n, v in fmt.JOURNAL_DEFAULTS.items()}
    )


def render_journal(entries: DataFrame, keep: list[str]) -> DataFrame:
    fields = ("title", "published", "link", "summary")
    return entry_defaults(entries).select(
        *keep,
        tx.render_journal_html(*fields).alias("html"),
        tx.render_journal_text(*fields).alias("plain"),
    )


def journal_digest(fresh: DataFrame, run_date: dt.date, per_part: int = PER_PART) -> DataFrame:
    """Digest of entries already known to be new; no row when there are none."""
    parts = digest_concat(
        fresh,
        ["site"],
        ["pos"],
        render_journal,
        F.lit(fmt.JOURNAL_HEADER),
        F.lit(fmt.JOURNAL_FOOTER),
        F.lit(fmt.JOURNAL_PLAIN_HEADER),
        per_part,
    )
    named = parts.withColumns(
        {
            "config_pos": F.lit(0).cast("bigint"),
            "kind": F.lit("journal"),
            "subject": F.lit(fmt.JOURNAL_SUBJECT),
        }
    )
    return digest_table(named, run_date)


def new_entries_digest(
    current: DataFrame, seen: DataFrame, run_date: dt.date, per_part: int = PER_PART
) -> DataFrame:
    fresh = durable(novelty.new_entries(current, seen), "new-entries")
    return journal_digest(fresh, run_date, per_part)


def run_journal(
    current: DataFrame,
    state: SeenLinks,
    digest_path: str,
    run_date: dt.date,
    snapshot: str | None = None,
    per_part: int = PER_PART,
) -> bool:
    """One run: digest of the new entries, then the new state.  False if nothing was new.

    ``snapshot`` names what the run takes in; a snapshot taken in before is skipped.  Each version of
    the state has digests of its own, so several snapshots of a day all keep theirs.
    """
    if snapshot is not None and state.has(snapshot):
        return False
    fresh = durable(novelty.new_entries(current, state.read()), "new-entries")
    if fresh.isEmpty():
        if snapshot is not None:
            state.keep(snapshot)
        return False
    version = (state.version() or 0) + 1
    write_digests(journal_digest(fresh, run_date, per_part), digest_path, f"v{version}")
    state.write(novelty.distinct_links(current), version, snapshot)
    return True
