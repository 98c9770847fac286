"""Weekly digest: matches pile up as state and go out on Sundays, two digests per site."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedwatch.functions import formats as fmt
from feedwatch.functions import text as tx
from feedwatch.operators import match as mt
from feedwatch.operators.joins import join_small
from feedwatch.operators.digest import PER_PART, digest_concat
from feedwatch.plans.daily import digest_table, render_matches
from feedwatch.session import durable
from feedwatch.sources.state import MatchState, write_digests

KINDS = list(fmt.WEEKLY_SUBJECTS)


def weekly_matches(entries: DataFrame, watch: DataFrame, append_date) -> DataFrame:
    """State rows of one run (``append_date``: a date or a column)."""
    day = append_date if not isinstance(append_date, dt.date) else F.lit(append_date)
    return mt.saved_match_row(mt.matched_entries(entries, watch), day)


def rules_by_site(watch: DataFrame) -> DataFrame:
    """One rule per site; lists of a site that is configured twice follow one another."""
    rules = watch.groupBy("site").agg(
        F.min("rule_pos").alias("config_pos"),
        F.array_sort(F.collect_list(F.struct("rule_pos", "authors", "words"))).alias("rules"),
    )

    def merged_list(name: str):
        return F.flatten(F.transform("rules", lambda r: mt.clean_terms(r[name]))).alias(name)

    merged = rules.select("site", "config_pos", merged_list("authors"), merged_list("words"))
    return merged.withColumn("forms", tx.word_forms(F.col("words")))


def sites_and_kinds(rules: DataFrame) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return rules.select("site", "config_pos", F.explode(kinds).alias("kind"))


def with_fallbacks(slots: DataFrame, parts: DataFrame, present: DataFrame) -> DataFrame:
    """Every (site, kind) gets a digest: its parts, or the fallback text if it is not ``present``.

    Texts of digests are not moved: parts get their rule's place by a join with the measured, small
    slots, and slots without parts are found by their keys alone.
    """
    found = join_small(parts, slots, ["site", "kind"], "part")
    empty = slots.join(present.select("site", "kind").distinct(), ["site", "kind"], "left_anti")
    fallback = tx.weekly_fallback("site", "kind")
    empty = empty.withColumns(
        {
            "html": F.concat(F.lit("<b>"), fallback, F.lit("</b>")),
            "plain": fallback,
            "part": F.lit(0).cast("bigint"),
            "n_parts": F.lit(1).cast("bigint"),
            "n_entries": F.lit(0).cast("bigint"),
        }
    )
    titled = found.withColumn("subject", tx.weekly_subject("site", "kind", F.lit(True)))
    return titled.unionByName(empty.withColumn("subject", tx.weekly_subject("site", "kind", F.lit(False))))


def first_copies(saved: DataFrame) -> DataFrame:
    """Optional: only the earliest copy of an entry per site (by default every copy is sent).

    An entry is known by its id, else its link, else its position; what has none of them stays.
    Later copies are dropped before the shuffle where a task holds both.
    """
    ident = F.coalesce("entry.id", "entry.link", F.col("entry.pos").cast("string"))
    named = saved.withColumn("_key", ident)
    age = Window.partitionBy("site", "_key").orderBy("append_date", "rule_pos", "entry.pos")
    first = named.where("_key is not null").withColumn("_copy", F.row_number().over(age)).where("_copy = 1")
    return first.drop("_copy").unionByName(named.where("_key is null")).select(*saved.columns)


def weekly_digest(
    saved: DataFrame, watch: DataFrame, run_date: dt.date, per_part: int = PER_PART
) -> DataFrame:
    """Digests of the given state rows, in append order, author and keyword matches apart."""
    rules = rules_by_site(watch)
    labelled = saved.select(
        "site", "match", "append_date", "rule_pos", "entry.*", mt.match_kind("match").alias("kind")
    )
    keys, order = ["site", "kind"], ["append_date", "rule_pos", "pos"]
    parts = digest_concat(
        labelled,
        keys,
        order,
        lambda placed, keep: render_matches(join_small(placed, rules, "site", "pos"), keep),
        F.lit(fmt.MATCH_HEADER),
        F.lit(fmt.MATCH_FOOTER),
        per_part=per_part,
    )
    return digest_table(with_fallbacks(sites_and_kinds(rules), parts, labelled), run_date)


def flush_dates(append_dates: DataFrame, runs: DataFrame, day: str = "append_date") -> DataFrame:
    """First Sunday run on or after each append date; null while there is none yet.

    Sundays of the calendar are one small array (52 a year), so no range join is needed.
    """
    sundays = (
        runs.where(tx.is_flush_day("run_date"))
        .agg(F.sort_array(F.collect_set("run_date")).alias("sundays"))
        .scalar()
    )
    days = append_dates.select(day).distinct().withColumn("sundays", sundays)
    due = F.array_min(F.filter("sundays", lambda s: s >= F.col(day)))
    return days.select(day, due.alias("flush_date"))


def with_flush_date(saved: DataFrame, runs: DataFrame) -> DataFrame:
    return saved.join(flush_dates(saved, runs), "append_date")


def run_weekly(
    entries: DataFrame,
    watch: DataFrame,
    state: MatchState,
    digest_path: str,
    run_date: dt.date,
    per_part: int = PER_PART,
    run_id: str | None = None,
) -> bool:
    """One run: append its matches and flush on Sundays.  True if it flushed.

    A run is known by its id, by default its date.  A run that failed anywhere is repeated under its id:
    its matches are appended once, and its digests replace those it wrote.  Another run of the day
    has an id of its own; on a Sunday it sends what has come since.  A flush sends all that is
    pending, late rows too, for the sites of the watchlist; other sites' rows wait.
    """
    run_id = run_date.isoformat() if run_id is None else run_id
    state.append(weekly_matches(entries, watch, run_date), run_id)
    if run_date.weekday() != fmt.SUNDAY or state.is_flushed(run_id):
        return False
    pending = durable(state.pending(run_date, watch), "pending")
    write_digests(weekly_digest(pending, watch, run_date, per_part), digest_path, run_id)
    state.clear(run_date, watch, run_id)
    return True
