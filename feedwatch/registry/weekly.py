"""Weekly state and digests, in batch and as streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from feedwatch.functions import formats as fmt
from feedwatch.operators import match as mt
from feedwatch.operators.digest import PER_PART
from feedwatch.plans import weekly as plan
from feedwatch.registry import register
from feedwatch.registry import views as v
from feedwatch.registry.matching import digest_columns, parts_sql
from feedwatch.session import durable, fresh_path
from feedwatch.sources.state import MatchState, SeenLinks, read_digests, write_digests
from feedwatch.streaming import flows

SAVED = "WITH" + v.SAVED
FLUSH = dt.date(2024, 1, 14)
WEEK = f"append_date BETWEEN DATE '{FLUSH - dt.timedelta(days=6)}' AND DATE '{FLUSH}'"


@register(
    "weekly_window",
    SAVED + "SELECT week, site, kind, count(*) AS n FROM saved GROUP BY ALL",
)
def weekly_window(spark, sf_dir):
    rows = v.saved(spark, sf_dir).withColumn("kind", mt.match_kind("match"))
    return rows.groupBy("week", "site", "kind").agg(F.count("*").alias("n"))


# Dates without a Sunday run: the second one of the calendar is left out, so its rows go out later.
_SUNDAYS = """
runs AS (SELECT DISTINCT append_date AS run_date FROM saved WHERE append_date <> DATE '2024-01-14'),
due AS (SELECT a.append_date, min(r.run_date) AS flush_date
        FROM (SELECT DISTINCT append_date FROM saved) a
        LEFT JOIN runs r ON r.run_date >= a.append_date AND isodow(r.run_date) = 7 GROUP BY 1)"""


@register(
    "late_flush",
    SAVED + "," + _SUNDAYS + """
SELECT append_date, flush_date, site, count(*) AS n FROM saved JOIN due USING (append_date) GROUP BY ALL""",
)
def late_flush(spark, sf_dir):
    saved = v.saved(spark, sf_dir)
    runs = saved.select(F.col("append_date").alias("run_date")).distinct()
    runs = runs.where(F.col("run_date") != F.lit(FLUSH))
    due = plan.with_flush_date(saved, runs)
    return due.groupBy("append_date", "flush_date", "site").agg(F.count("*").alias("n"))


@register(
    "weekly_duplicates",
    SAVED + "SELECT site, match, 2 * count(*) AS n, count(*) AS n_distinct FROM saved GROUP BY ALL",
)
def weekly_duplicates(spark, sf_dir):
    """Rows appended twice stay twice."""
    saved = v.saved(spark, sf_dir)
    state = MatchState(spark, fresh_path(spark, "duplicates"))
    state.append(saved)
    state.append(saved)
    rows = state.read().groupBy("site", "match").agg(F.count("*").alias("n"))
    once = state.read().select("site", "match", "entry.id").distinct()
    distinct = once.groupBy("site", "match").agg(F.count("*").alias("n_distinct"))
    return rows.join(distinct, ["site", "match"])


@register(
    "append_all",
    SAVED + "SELECT site, week, count(*) AS n FROM saved GROUP BY ALL",
)
def append_all(spark, sf_dir):
    """Two appends (errors, then the others) make one bag."""
    saved = v.saved(spark, sf_dir)
    state = MatchState(spark, fresh_path(spark, "append"))
    state.append(saved.where("match = 'author'"))
    state.append(saved.where("match <> 'author'"))
    return state.read().groupBy("site", "week").agg(F.count("*").alias("n"))


@register(
    "match_state_append",
    v.LABELLED + """
SELECT rule_pos, site, match, pos, md5(summary) AS summary_md5, DATE '2026-12-06' AS append_date FROM matched""",
)
def match_state_append(spark, sf_dir):
    state = MatchState(spark, fresh_path(spark, "append"))
    state.append(plan.weekly_matches(v.entries(spark, sf_dir), v.watch(spark), v.RUN_DATE))
    return state.read().select(
        "rule_pos",
        "site",
        "match",
        "entry.pos",
        v.short("entry.summary").alias("summary_md5"),
        "append_date",
    )


@register(
    "match_state_read",
    SAVED + """
SELECT pos, match, append_date FROM saved WHERE site = 'u1' AND week = DATE '2024-01-08'""",
)
def match_state_read(spark, sf_dir):
    """One site's matches of one week, by partition pruning."""
    state = MatchState(spark, fresh_path(spark, "read"))
    state.append(v.saved(spark, sf_dir))
    rows = state.read("u1", dt.date(2024, 1, 8))
    return rows.select("entry.pos", "match", "append_date")


@register(
    "match_state_clear",
    SAVED + """
SELECT site, count(*) AS n FROM saved
WHERE append_date > DATE '2024-01-14' AND append_date <= DATE '2024-01-21' GROUP BY site""",
)
def match_state_clear(spark, sf_dir):
    """After a flush only later rows are pending; nothing is deleted."""
    state = MatchState(spark, fresh_path(spark, "clear"))
    state.append(v.saved(spark, sf_dir))
    state.clear(FLUSH)
    pending = state.pending(FLUSH + dt.timedelta(days=7))
    return pending.groupBy("site").agg(F.count("*").alias("n"))


@register(
    "weekly_matches",
    v.LABELLED + """
SELECT site, match, count(*) AS n, DATE '2026-11-30' AS week FROM matched GROUP BY ALL""",
)
def weekly_matches(spark, sf_dir):
    rows = plan.weekly_matches(v.entries(spark, sf_dir), v.watch(spark), v.RUN_DATE)
    return rows.groupBy("site", "match", "week").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- digests

def _rendered_week(where: str, per_part: int = PER_PART) -> str:
    words = "['click', 'error']"
    who = """list_transform(string_split(author, ', '), lambda n:
      CASE WHEN instr(n, 'U' || rule_pos) >= 1 THEN '<b>' || n || '</b>' ELSE n END)"""
    return f""",
week_rows AS (SELECT * FROM saved WHERE {where}),
rendered AS (
  SELECT *, '<div><p style="color:blue;font-size:1.17em;"><b><a href="' || link || '">'
    || {v.wrap_sql("title", words, fmt.TITLE_TAGS)} || '</a></b></p><p><i>'
    || CASE WHEN match = 'author' THEN array_to_string({who}, ' , ') || ' ' ELSE author END
    || '<i></p><br><p>' || {v.wrap_sql(v.body_sql("summary"), words, fmt.BOLD_TAGS)}
    || '</p><br><br></div>' AS html,
    title || chr(10) || ' ' || chr(9) || author || chr(10) || ' ' || chr(10) || {v.body_sql("summary")}
    || chr(10) || ' ' || chr(10) AS plain
  FROM week_rows)""" + parts_sql(
        "rendered", "site, kind", "append_date, rule_pos, pos", per_part,
        v.sql_text(fmt.MATCH_HEADER), v.sql_text(fmt.MATCH_FOOTER),
    ) + """,
slots_out AS (SELECT 'u' || n AS site, n AS config_pos, kind
              FROM range(0, 6) r(n), (VALUES ('author'), ('keyword')) k(kind)),
labelled_slots AS (
  SELECT s.*, f.html, f.plain, f.part, f.n_parts, coalesce(f.n_entries, 0) AS n_entries,
         CASE WHEN s.kind = 'author' THEN 'No author matches found for ' ELSE 'No keyword matches found for ' END
           || s.site || ' arxiv topic' AS fallback,
         CASE WHEN s.kind = 'author' THEN 'Filtered author matches for ' ELSE 'Filtered matches for ' END
           || s.site AS hit
  FROM slots_out s LEFT JOIN parts f USING (site, kind)),
digests AS (
  SELECT config_pos, site, kind, n_entries, CASE WHEN html IS NULL THEN fallback ELSE hit END AS subject,
         coalesce(part, 0) AS part, coalesce(n_parts, 1) AS n_parts,
         coalesce(html, '<b>' || fallback || '</b>') AS html, coalesce(plain, fallback) AS plain
  FROM labelled_slots)"""


_DIGEST_ROW = """
SELECT DATE '2024-01-14' AS run_date, config_pos, site, kind, part, n_parts, subject, n_entries,
       md5(html) AS html_md5, length(html) AS html_len, md5(plain) AS plain_md5
FROM digests"""


@register("weekly_digest", SAVED + _rendered_week("TRUE", 300) + _DIGEST_ROW)
def weekly_digest(spark, sf_dir):
    """Digests of everything saved, in parts of 300 entries and more; one site has no matches."""
    digests = plan.weekly_digest(v.saved(spark, sf_dir), v.saved_watch(spark), FLUSH, per_part=300)
    return digest_columns(digests)


@register("weekly_flush", SAVED + _rendered_week(WEEK) + _DIGEST_ROW)
def weekly_flush(spark, sf_dir):
    """State appended, flushed on one Sunday and flushed again on the next one."""
    base = fresh_path(spark, "flush")
    state, watch = MatchState(spark, base), v.saved_watch(spark)
    state.append(v.saved(spark, sf_dir))
    state.clear(FLUSH - dt.timedelta(days=7))
    write_digests(plan.weekly_digest(state.pending(FLUSH), watch, FLUSH), f"{base}/digests")
    state.clear(FLUSH)
    return digest_columns(read_digests(spark, f"{base}/digests").drop("run_id"))


def _runs(spark, sf_dir):
    """Saved rows as days of runs, into one state; everything is sent in the end.

    Two sites are missing from the first flush's watchlist, a third of the rows come late (in runs of
    their own, under their old dates), every append is repeated, and a Sunday has a second run.
    """
    base = fresh_path(spark, "runs")
    state, saved, watch = MatchState(spark, base), v.saved(spark, sf_dir), v.saved_watch(spark)
    late, last = F.col("entry.pos") % 3 == 0, dt.date(2024, 12, 29)
    steps = [
        ("week", saved.where(~late & (F.col("append_date") <= F.lit(FLUSH))), FLUSH, watch.where("site not in ('u1', 'u2')")),
        ("second", saved.where(late & (F.col("append_date") == F.lit(FLUSH))), FLUSH, watch),
        ("rest", saved.where(~late & (F.col("append_date") > F.lit(FLUSH))), last, watch),
        ("late", saved.where(late & (F.col("append_date") != F.lit(FLUSH))), last, watch),
    ]
    for run, rows, day, rules in steps:
        state.append(rows, run)
        state.append(rows, run)  # repeated after a failure
        pending = durable(state.pending(day, rules), "pending")
        write_digests(plan.weekly_digest(pending, rules, day), f"{base}/digests", run)
        state.clear(day, rules, run)
    return state, f"{base}/digests"


_STEPS = SAVED + f""",
late AS (SELECT *, pos % 3 = 0 AS is_late, append_date <= DATE '{FLUSH}' AS early FROM saved),
sent AS (SELECT *, CASE
    WHEN NOT is_late AND early AND site NOT IN ('u1', 'u2') THEN 'week'
    WHEN (is_late AND append_date = DATE '{FLUSH}') OR (NOT is_late AND early) THEN 'second'
    WHEN NOT is_late THEN 'rest' ELSE 'late' END AS run_id FROM late)"""


@register("weekly_runs", _STEPS + """
SELECT run_id, site, kind, count(*) AS n_entries FROM sent GROUP BY ALL""")
def weekly_runs(spark, sf_dir):
    """What each run sent: late rows, a second Sunday run, sites absent on a flush day, repeats."""
    _, digests = _runs(spark, sf_dir)
    sent = read_digests(spark, digests).where("part = 0 and n_entries > 0")
    return sent.select("run_id", "site", "kind", "n_entries")


@register("weekly_all_sent", SAVED + """
SELECT site, count(*) AS n_appended, count(*) AS n_sent, 0::BIGINT AS n_pending FROM saved GROUP BY site""")
def weekly_all_sent(spark, sf_dir):
    """After the last flush everything appended has been sent once."""
    state, digests = _runs(spark, sf_dir)
    sent = read_digests(spark, digests).where("part = 0").groupBy("site").agg(F.sum("n_entries").alias("n_sent"))
    left = state.pending(dt.date(2025, 1, 1)).groupBy("site").agg(F.count("*").alias("n_pending"))
    held = state.read().groupBy("site").agg(F.count("*").alias("n_appended"))
    return held.join(sent, "site").join(left, "site", "left").select(
        "site", "n_appended", "n_sent", F.coalesce("n_pending", F.lit(0)).cast("bigint").alias("n_pending")
    )


@register(
    "sites_left_outer_digest",
    SAVED + _rendered_week("TRUE") + """
SELECT config_pos, site, kind, subject, n_entries FROM digests WHERE part = 0""",
)
def sites_left_outer_digest(spark, sf_dir):
    """Both digests of every site; one site has no matches and gets the fallbacks."""
    digests = plan.weekly_digest(v.saved(spark, sf_dir), v.saved_watch(spark), FLUSH)
    return digests.where("part = 0").select("config_pos", "site", "kind", "subject", "n_entries")


@register(
    "digest_sink",
    SAVED + _rendered_week("TRUE") + "SELECT site, kind, part, subject, md5(html) AS html_md5 FROM digests",
)
def digest_sink(spark, sf_dir):
    """A repeated write replaces what its run wrote; other kinds and runs of the day stay."""
    path = fresh_path(spark, "sink")
    digests = plan.weekly_digest(v.saved(spark, sf_dir), v.saved_watch(spark), FLUSH)
    write_digests(digests, path)
    write_digests(digests, path)
    write_digests(digests.withColumn("kind", F.lit("other")), path)
    write_digests(digests, path, "second")
    kept = read_digests(spark, path)
    others = kept.where("kind = 'other' or run_id = 'second'").count()
    kept = kept.where(F.lit(others == 2 * digests.count()) & (F.col("run_id") == "0") & (F.col("kind") != "other"))
    return kept.select("site", "kind", "part", "subject", v.short("html").alias("html_md5"))


# ---------------------------------------------------------------- streams


def _stream(spark, sf_dir, name):
    """A table as a file stream, whether it is one file or a folder of files."""
    schema = v.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


@register(
    "incremental_match",
    v.LABELLED + "SELECT rule_pos, site, match, pos, md5(title) AS title_md5 FROM matched",
)
def incremental_match(spark, sf_dir):
    """The match stream over landed entries, written to the weekly state."""
    base = fresh_path(spark, "stream")
    docs = _stream(spark, sf_dir, "documents")
    doc_id = F.col("doc_id").cast("string")
    entries = docs.select(
        F.col("source").alias("site"),
        F.col("doc_id").alias("pos"),
        doc_id.alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        v.first_tokens().alias("author"),
        F.col("text").alias("summary"),
        F.concat(F.lit("https://example.org/abs/"), doc_id).alias("link"),
        F.lit(None).cast("string").alias("published"),
    )
    query = flows.start_match_stream(
        entries, v.watch(spark), F.lit(v.RUN_DATE), state := MatchState(spark, base), f"{base}/checkpoint"
    )
    query.awaitTermination()
    return state.read().select(
        "rule_pos", "site", "match", "entry.pos", v.short("entry.title").alias("title_md5")
    )


@register(
    "weekly_window_stream",
    SAVED + """
SELECT week, site, kind, count(*) AS n FROM saved
WHERE week + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL""",
)
def weekly_window_stream(spark, sf_dir):
    """Streaming counts: weeks the watermark has passed; the open week is still pending."""
    base = fresh_path(spark, "stream")
    kind = F.when(F.col("event_type") == "error", "author").otherwise("keyword")
    rows = _stream(spark, sf_dir, "events").select(
        "ts", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("site"), kind.alias("kind")
    )
    query = (
        flows.weekly_counts(rows)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{base}/counts")
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/counts")


_JOURNAL = """
WITH first_links AS (SELECT DISTINCT url AS link FROM pages WHERE url LIKE 'https:%'),
all_links AS (SELECT url AS link FROM pages)"""


def _two_snapshots(spark, sf_dir):
    """Two landed snapshots of several files (the https part of the pages, then all of them), streamed."""
    base = fresh_path(spark, "snapshots")
    now = v.snapshot(spark, sf_dir)
    for name, part in (("s1", now.where(F.col("link").startswith("https:"))), ("s2", now)):
        flows.land_snapshot(part.repartition(3), base, name)
    state = SeenLinks(spark, base)
    query = flows.start_new_entries_stream(
        spark, base, state, f"{base}/digests", v.RUN_DATE, f"{base}/checkpoint"
    )
    query.awaitTermination()
    return base, state


@register(
    "new_since_snapshot_stream",
    _JOURNAL + """
SELECT 0 AS batch, count(*) AS n_new FROM all_links WHERE link LIKE 'https:%'
UNION ALL SELECT 1, count(*) FROM all_links WHERE link NOT IN (SELECT link FROM first_links)""",
)
def new_since_snapshot_stream(spark, sf_dir):
    base, _ = _two_snapshots(spark, sf_dir)
    digests = read_digests(spark, f"{base}/digests").where("part = 0")
    batch = F.substring("run_id", 2, 10).cast("int") - 1
    return digests.select(batch.alias("batch"), F.col("n_entries").alias("n_new"))


@register("state_before_delivery", "SELECT DISTINCT url AS link FROM pages")
def state_before_delivery(spark, sf_dir):
    """State left by the stream; every snapshot's digest was written before its state."""
    _, state = _two_snapshots(spark, sf_dir)
    return state.read()


@register("seen_links_write", "SELECT DISTINCT url AS link FROM pages")
def seen_links_write(spark, sf_dir):
    state = SeenLinks(spark, fresh_path(spark, "seen"))
    state.write(v.stored(spark, sf_dir), 1)
    state.write(v.snapshot(spark, sf_dir).select("link").distinct(), 2)
    return state.read()


@register(
    "seen_links_read",
    """
SELECT url AS link, url LIKE 'https:%' AS stored FROM pages GROUP BY url""",
)
def seen_links_read(spark, sf_dir):
    """Nothing is stored before the first write; afterwards the stored links are known."""
    state = SeenLinks(spark, fresh_path(spark, "seen"))
    first = state.read()
    state.write(v.stored(spark, sf_dir).unionByName(first, allowMissingColumns=True), 1)
    links = v.snapshot(spark, sf_dir).select("link").distinct()
    known = state.read().withColumn("stored", F.lit(True))
    return links.join(known, "link", "left").select(
        "link", F.coalesce("stored", F.lit(False)).alias("stored")
    )


@register(
    "union_sites",
    v.LABELLED + """
SELECT site, min(rule_pos) AS first_rule, count(*) AS n FROM matched GROUP BY site""",
)
def union_sites(spark, sf_dir):
    """All sites in one pass: the site is a column and not a loop."""
    rows = mt.matched_entries(v.entries(spark, sf_dir), v.watch(spark))
    return rows.groupBy("site").agg(F.min("rule_pos").alias("first_rule"), F.count("*").alias("n"))
