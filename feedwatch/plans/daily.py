"""Daily digest: match every entry of the watched feeds and send what matched, site by site."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwatch import schemas
from feedwatch.functions import formats as fmt
from feedwatch.functions import text as tx
from feedwatch.operators import match as mt
from feedwatch.operators.digest import PER_PART, digest_concat
from feedwatch.operators.joins import join_small
from feedwatch.session import durable

def _text(name: str):
    """A missing field renders as empty text; a null would silently drop the entry."""
    return F.coalesce(F.col(name), F.lit(""))


def render_matches(matched: DataFrame, keep: list[str]) -> DataFrame:
    """``html`` and ``plain`` of every matched entry (a map, no shuffle)."""
    return matched.select(
        *keep,
        tx.render_entry_html(
            _text("title"),
            _text("author"),
            _text("summary"),
            _text("link"),
            F.col("match"),
            F.col("forms"),
            F.col("authors"),
        ).alias("html"),
        tx.render_entry_text(_text("title"), _text("author"), _text("summary")).alias("plain"),
    )


def with_rules(matched: DataFrame, watch: DataFrame) -> DataFrame:
    """Rule columns again, for rendering.  Matches are stored and moved without these long lists."""
    rules = mt.prepare_watchlist(watch)
    return join_small(matched, rules, ["rule_pos", "site"], salt_by="pos")


def digest_table(parts: DataFrame, run_date: dt.date) -> DataFrame:
    return parts.withColumn("run_date", F.lit(run_date).cast("date")).select(
        *schemas.DIGEST.fieldNames()
    )


def daily_digest(
    entries: DataFrame,
    watch: DataFrame,
    run_date: dt.date,
    per_part: int = PER_PART,
    position_zero_matches: bool = False,
) -> DataFrame:
    """Digest parts of every rule with matches; one notice if no rule has any.

    The matches are written once: the feed is scanned a single time, and layout, concatenation and
    the emptiness test read the much smaller match table.
    """
    matched = mt.matched_entries(entries, watch, position_zero_matches)
    keys = ["rule_pos", "site"]
    matched = durable(matched.select(*keys, "match", *schemas.ENTRY_FIELDS), "matches")
    parts = digest_concat(
        matched,
        keys,
        ["pos"],
        lambda placed, keep: render_matches(with_rules(placed, watch), keep),
        F.lit(fmt.MATCH_HEADER),
        F.lit(fmt.MATCH_FOOTER),
        per_part=per_part,
    )
    found = parts.withColumnsRenamed({"rule_pos": "config_pos"}).withColumns(
        {"kind": F.lit("daily"), "subject": tx.daily_subject("site")}
    )
    notice = nothing_found(watch, matched)
    return digest_table(found.unionByName(notice.select(*found.columns)), run_date)


def nothing_found(watch: DataFrame, matched: DataFrame) -> DataFrame:
    """The notice row, present only if every configured rule is without a match."""
    empty = mt.all_sites_empty(watch, matched).where("all_empty")
    return empty.select(
        F.lit(None).cast("bigint").alias("config_pos"),
        F.lit(None).cast("string").alias("site"),
        F.lit("notice").alias("kind"),
        F.lit(0).cast("bigint").alias("part"),
        F.lit(1).cast("bigint").alias("n_parts"),
        F.lit(0).cast("bigint").alias("n_entries"),
        F.lit(fmt.NOTHING_FOUND).alias("subject"),
        F.lit(f"<b>{fmt.NOTHING_FOUND}</b>").alias("html"),
        F.lit(fmt.NOTHING_FOUND).alias("plain"),
    )
