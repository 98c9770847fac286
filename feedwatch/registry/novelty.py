"""New entries against a stored snapshot, and the journal digest."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedwatch.functions import formats as fmt
from feedwatch.operators import novelty as nv
from feedwatch.plans.journal import entry_defaults as defaults
from feedwatch.plans.journal import new_entries_digest, render_journal
from feedwatch.registry import register
from feedwatch.registry import views as v
from feedwatch.registry.matching import DIGEST_SQL, digest_columns, parts_sql
from feedwatch.session import fresh_path
from feedwatch.streaming.snapshots import KEYS, start_new_keys_stream

WITH = "WITH" + v.SNAPSHOT
FRESH = WITH + ", fresh AS (SELECT * FROM snapshot WHERE link NOT IN (SELECT link FROM stored))"


@register("new_entries_by_link", FRESH + "SELECT pos, id, link FROM fresh")
def new_entries_by_link(spark, sf_dir):
    fresh = nv.new_entries(v.snapshot(spark, sf_dir), v.stored(spark, sf_dir))
    return fresh.select("pos", "id", "link")


@register(
    "new_entries_by_id",
    WITH + "SELECT pos, id, link FROM snapshot WHERE id NOT IN (SELECT id FROM stored)",
)
def new_entries_by_id(spark, sf_dir):
    fresh = nv.new_entries(v.snapshot(spark, sf_dir), v.stored(spark, sf_dir), key="id")
    return fresh.select("pos", "id", "link")


@register(
    "link_difference",
    FRESH + "SELECT link, 2 * count(*) AS n FROM fresh GROUP BY link",
)
def link_difference(spark, sf_dir):
    """Bag difference: a snapshot that lists everything twice keeps both copies."""
    snapshot = v.snapshot(spark, sf_dir)
    twice = nv.link_difference(snapshot.unionAll(snapshot), v.stored(spark, sf_dir))
    return twice.groupBy("link").agg(F.count("*").alias("n"))


@register("distinct_links", WITH + "SELECT DISTINCT link FROM snapshot")
def distinct_links(spark, sf_dir):
    return nv.distinct_links(v.snapshot(spark, sf_dir))


@register(
    "new_since_snapshot",
    FRESH + """
SELECT link, TRUE AS was_new FROM (SELECT DISTINCT link FROM fresh)
UNION ALL SELECT link, FALSE FROM stored WHERE link IN (SELECT link FROM snapshot)""",
)
def new_since_snapshot(spark, sf_dir):
    """The stored set after the snapshot, with what was new in it."""
    snapshot, stored = v.snapshot(spark, sf_dir), v.stored(spark, sf_dir)
    state = nv.next_state(snapshot, stored)
    old = stored.select("link", F.lit(False).alias("known"))
    return state.join(old, "link", "left").select("link", F.col("known").isNull().alias("was_new"))


@register(
    "new_since_snapshots_stream",
    """
WITH held AS (SELECT source AS site, doc_id AS pos, 'd' || doc_id AS link, doc_id % 4 AS c, bool_or(doc_id % 4 = 2) OVER (PARTITION BY source) AS has2
              FROM documents)
SELECT site, 0::BIGINT AS snapshot, pos, link FROM held WHERE c IN (0, 1)
UNION ALL SELECT site, 1, pos, link FROM held WHERE c = 2
UNION ALL SELECT site, 2, pos, link FROM held WHERE c = 0 AND has2""",
)
def new_since_snapshots_stream(spark, sf_dir):
    """Four snapshots of every feed in two runs of one stream: entries come, leave, return (and are new again) and stay."""
    base = fresh_path(spark, "snapshots")
    docs = v.table(spark, sf_dir, "documents")
    entries = docs.select(
        F.col("source").alias("site"), F.col("doc_id").alias("pos"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("link"),
        (F.col("doc_id") % 4).alias("c"),
    )
    kinds = "site string, pos bigint, link string, snapshot bigint"
    for first in (0, 2):
        for number in (first, first + 1):
            own = entries.where(F.col("c").isin(*((0, 1), (1, 2), (0, 2), (0, 2))[number])).drop("c")
            own.withColumn("snapshot", F.lit(number).cast("bigint")).write.mode("append").parquet(f"{base}/landed")
        landed = spark.readStream.schema(kinds).parquet(f"{base}/landed")
        start_new_keys_stream(landed, f"{base}/new", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(KEYS).parquet(f"{base}/new")


@register(
    "entry_defaults",
    WITH + """
SELECT pos, coalesce(title, 'No Title') AS title, coalesce(link, '') AS link,
       coalesce(published, 'No Date') AS published, coalesce(summary, '') AS summary
FROM snapshot""",
)
def entry_defaults(spark, sf_dir):
    return defaults(v.snapshot(spark, sf_dir)).select("pos", "title", "link", "published", "summary")


def rendered_sql(source: str) -> str:
    return f""",
filled AS (SELECT site, pos, coalesce(title, 'No Title') AS title, coalesce(link, '') AS link,
                  coalesce(published, 'No Date') AS published, coalesce(summary, '') AS summary FROM {source}),
rendered AS (
  SELECT site, pos, chr(10) || '<li><strong>' || {v.escape_sql("title")} || '</strong><br>' || chr(10) || '<em>'
    || {v.escape_sql("published")} || '</em><br>' || chr(10) || '<a href=''' || link || '''>' || link || '</a><br>'
    || chr(10) || CASE WHEN summary <> '' THEN '<p>' || summary || '</p>' || chr(10) ELSE '' END || '</li><br>' AS html,
    chr(10) || title || chr(10) || published || chr(10) || link || chr(10)
    || CASE WHEN summary <> '' THEN chr(10) || summary || chr(10) ELSE '' END || chr(10) || chr(10) AS plain
  FROM filled)"""


@register(
    "render_journal",
    WITH + rendered_sql("snapshot") + """
SELECT pos, md5(html) AS html_md5, md5(plain) AS plain_md5 FROM rendered""",
)
def journal_items(spark, sf_dir):
    return render_journal(v.snapshot(spark, sf_dir), ["pos"]).select(
        "pos", v.short("html").alias("html_md5"), v.short("plain").alias("plain_md5")
    )


@register(
    "new_entries_digest",
    FRESH + rendered_sql("fresh") + parts_sql(
        "rendered", "site", "pos", 32, v.sql_text(fmt.JOURNAL_HEADER), v.sql_text(fmt.JOURNAL_FOOTER),
        v.sql_text(fmt.JOURNAL_PLAIN_HEADER),
    ) + DIGEST_SQL.format(
        pos="0::BIGINT", kind="journal", subject=v.sql_text(fmt.JOURNAL_SUBJECT)
    ),
)
def journal(spark, sf_dir):
    digests = new_entries_digest(
        v.snapshot(spark, sf_dir), v.stored(spark, sf_dir), v.RUN_DATE, per_part=32
    )
    return digest_columns(digests)
