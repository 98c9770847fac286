"""Round trips through the landed file formats, with rows taken from the tables."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from feedwatch.functions import text as tx
from feedwatch.operators import match as mt
from feedwatch.operators import similarity as sim
from feedwatch.registry import register
from feedwatch.registry import views as v
from feedwatch.plans.weekly import run_weekly
from feedwatch.session import fresh_path
from feedwatch.sources import configs as cf
from feedwatch.sources import feeds as fd
from feedwatch.sources.state import MatchState, read_digests
from feedwatch.streaming import flows

_SCAN = "WITH" + v.ENTRIES + """
SELECT site, pos, id, md5(title) AS title_md5, author, md5(summary) AS summary_md5, link, published FROM entries"""


def _scanned(entries, *more):
    return entries.select(
        *more,
        "site",
        "pos",
        "id",
        v.short("title").alias("title_md5"),
        "author",
        v.short("summary").alias("summary_md5"),
        "link",
        "published",
    )


@register("feed_scan_site", _SCAN)
def feed_scan_site(spark, sf_dir):
    root = fresh_path(spark, "feeds")
    fd.land_feed(v.entries(spark, sf_dir), f"{root}/feed_kind=site")
    return _scanned(fd.read_site_feed(spark, root, landed_pos=True))


@register("feed_scan_new", _SCAN)
def feed_scan_new(spark, sf_dir):
    root = fresh_path(spark, "feeds")
    fd.land_feed(v.entries(spark, sf_dir), f"{root}/feed_kind=new")
    return _scanned(fd.read_new_feed(spark, root, landed_pos=True))


@register(
    "feed_scan_journal",
    "WITH" + v.SNAPSHOT + "SELECT site, pos, id, title, summary, link, published FROM snapshot",
)
def feed_scan_journal(spark, sf_dir):
    root = fresh_path(spark, "journal")
    fd.land_feed(v.snapshot(spark, sf_dir), root)
    feed = fd.read_journal_feed(spark, root, landed_pos=True)
    return feed.select("site", "pos", "id", "title", "summary", "link", "published")


PAGE_POSITIONS = 400
PAGE_SITES = 64  # at most so many times as many positions, so a page of a site that has them all stays small


def _page(rows):
    """Number of the page of an item among ``rows``."""
    sites = rows.agg(F.count_distinct("site")).first()[0]
    return F.expr(f"pos div {PAGE_POSITIONS * min(max(sites, 1), PAGE_SITES)}")


def _delivered(spark, sf_dir, root):
    """Feeds as they are delivered: numbered pages of a site, RSS for even sites and Atom for odd ones, no positions.

    A page holds a site's items of neighbouring positions, ``PAGE_POSITIONS`` for each of the sites that share them, so a hot
    site has many files, and there are about as many files as ``PAGE_POSITIONS`` goes into the rows, however many sites there are.
    """
    rows = v.entries(spark, sf_dir).withColumn("odd", F.crc32(F.col("site").cast("binary")) % 2 == 1)
    e = v._element
    rss = F.concat(
        F.lit("<item>"), e("title", F.col("title")), F.lit("<dc:creator>"), tx.html_escape(F.col("author")), F.lit("</dc:creator>"),
        e("description", F.col("summary")), e("link", F.col("link")), F.lit('<guid isPermaLink="false">'), F.col("id"), F.lit("</guid>"),
        e("pubDate", F.col("published")), F.lit("</item>"),
    )
    atom = F.concat(
        F.lit("<entry>"), F.lit('<title type="text">'), tx.html_escape(F.col("title")), F.lit("</title><author><name>"),
        tx.html_escape(F.col("author")), F.lit("</name></author>"), F.lit('<summary type="html">'), tx.html_escape(F.col("summary")),
        F.lit('</summary><link rel="self" href="http://x/"/><link rel="alternate" href="'), F.col("link"), F.lit('"/>'),
        e("id", F.col("id")), e("published", F.col("published")), F.lit("</entry>"),
    )
    items = rows.select("site", "odd", "pos", F.when(F.col("odd"), atom).otherwise(rss).alias("x"))
    paged = items.withColumn("page", _page(rows))
    feeds = paged.groupBy("site", "odd", "page").agg(F.expr("listagg(x, '\n') WITHIN GROUP (ORDER BY pos)").alias("x"))
    head = F.when(F.col("odd"), F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>')).otherwise(
        F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>f</title>')
    )
    foot = F.when(F.col("odd"), F.lit("</feed>")).otherwise(F.lit("</channel></rss>"))
    text = feeds.select(F.concat(F.lit('<?xml version="1.0"?>'), head, "x", foot).alias("value"), "site", "page")
    text.write.partitionBy("site", "page").text(root)


@register(
    "feed_scan_delivered",
    "WITH" + v.ENTRIES + """
SELECT site, id, md5(title) AS title_md5, author, md5(summary) AS summary_md5, link, published,
       row_number() OVER (PARTITION BY site ORDER BY pos) AS place FROM entries""",
)
def feed_scan_delivered(spark, sf_dir):
    """RSS and Atom as delivered; positions made at reading keep the order of each file."""
    root = fresh_path(spark, "delivered")
    _delivered(spark, sf_dir, root)
    place = F.row_number().over(Window.partitionBy("site").orderBy("pos")).cast("bigint")
    return _scanned(fd.read_feed(spark, root).withColumn("place", place), "place").drop("pos")


@register(
    "feed_stream_delivered",
    v.LABELLED + """
SELECT site, kind, sum(n)::BIGINT AS n_entries FROM (
  SELECT site, CASE WHEN match = 'author' THEN 'author' ELSE 'keyword' END AS kind, count(*) AS n FROM matched GROUP BY ALL)
GROUP BY ALL""",
)
def feed_stream_delivered(spark, sf_dir):
    """Delivered feeds as streams into the weekly state; a batch run on Sunday sends every match."""
    base = fresh_path(spark, "delivered")
    _delivered(spark, sf_dir, f"{base}/landed")
    state = MatchState(spark, base)
    rows = v.entries(spark, sf_dir)
    files = rows.select("site", _page(rows)).distinct().count()  # a page is a file; to list them takes longer than to count
    stream = fd.stream_feed(spark, f"{base}/landed", max_files=-(-files // 3))  # three micro-batches
    flows.start_match_stream(stream, v.watch(spark), F.lit(v.RUN_DATE), state, f"{base}/checkpoint").awaitTermination()
    none = v.entries(spark, sf_dir).where("false")
    run_weekly(none, v.watch(spark), state, f"{base}/digests", v.RUN_DATE)
    sent = read_digests(spark, f"{base}/digests").where("part = 0 and n_entries > 0")
    return sent.select("site", "kind", "n_entries")


def _config_file(spark, text: str, suffix: str) -> str:
    """A configuration file as a user would provide it."""
    path = f"{fresh_path(spark, 'config')}/watch{suffix}"
    spark.createDataFrame([(text,)], "value string").write.text(path)
    return path


_CONFIGURED = v.LABELLED + "SELECT rule_pos, site, match, count(*) AS n FROM matched GROUP BY ALL"


def _rules() -> list[dict]:
    """The inline rules in file form; a missing list is left out or null."""
    found = []
    for n, site, authors, words in v.RULES:
        rule = {"arxivSite": site, "words": words}
        if authors is not None or n % 2:
            rule["authors"] = authors
        found.append(rule)
    return found


def _match_with(spark, sf_dir, path):
    rows = mt.matched_entries(v.entries(spark, sf_dir), cf.read_watchlist(spark, path))
    return rows.groupBy("rule_pos", "site", "match").agg(F.count("*").alias("n"))


@register("watchlist_json", _CONFIGURED)
def watchlist_json(spark, sf_dir):
    return _match_with(spark, sf_dir, _config_file(spark, json.dumps(_rules(), indent=2), ".json"))


@register("watchlist_yaml", _CONFIGURED)
def watchlist_yaml(spark, sf_dir):
    import yaml

    text = yaml.safe_dump({"arxiv_sites": _rules()})
    return _match_with(spark, sf_dir, _config_file(spark, text, ".yaml"))


@register(
    "similarity_config_json",
    "WITH" + v.ENTRIES + "," + v.SEARCHES + """
SELECT site, search_pos, target_pos, paper_id, n_entries, 4 AS k, 0.82::DOUBLE AS tau, TRUE AS use_and
FROM text_targets JOIN (SELECT site, count(*) AS n_entries FROM entries GROUP BY site) USING (site)""",
)
def similarity_config_json(spark, sf_dir):
    """A configuration naming every benchmark item, read back and joined with corpus and feed."""
    items = v.benchmark_searches(spark, sf_dir)
    # written by Spark as one file: the searches of a configuration are one document by format
    searches = items.groupBy("search_pos", F.col("site").alias("arxivSite")).agg(
        F.sort_array(F.collect_list(F.struct("target_pos", "paper_url"))).alias("p")
    )
    config = searches.agg(
        F.sort_array(
            F.collect_list(F.struct("search_pos", "arxivSite", F.col("p.paper_url").alias("papers")))
        ).alias("similarity_searches")
    ).withColumn(
        "settings",
        F.expr(
            "named_struct('num_similar_sentences', 4, 'title_similarity_threshold', 0.82D, "
            "'sentence_similarity_threshold', 0.82D, 'and_conditional', true)"
        ),
    )
    path = f"{fresh_path(spark, 'config')}/similarity.json"
    config.coalesce(1).write.json(path)
    read = cf.read_similarity_config(spark, path)
    settings: sim.Settings = cf.similarity_settings(read)
    targets = cf.attach_targets(cf.similarity_searches(read), v.benchmark_corpus(spark, sf_dir))
    sizes = v.entries(spark, sf_dir).groupBy("site").agg(F.count("*").alias("n_entries"))
    item = F.regexp_extract("paper_id", r"b(\d+)", 1).cast("int")
    return targets.join(sizes, "site").select(
        "site",
        "search_pos",
        item.alias("target_pos"),
        "paper_id",
        "n_entries",
        F.lit(settings.num_similar_sentences).alias("k"),
        F.lit(settings.title_threshold).alias("tau"),
        F.lit(settings.use_and).alias("use_and"),
    )


@register(
    "triplet_json",
    """
SELECT CAST(doc_id // 3 AS VARCHAR) AS triplet_id, ['anchor', 'positive', 'negative'][doc_id % 3 + 1] AS role,
       md5(split_part(text, chr(10), 1)) AS title_md5, md5(text) AS abstract_md5
FROM documents""",
)
def triplet_json(spark, sf_dir):
    """Documents as papers of triplets, written and read as JSON by role."""
    doc = F.col("doc_id")
    names = F.array(*(F.lit(r) for r in ("anchor", "positive", "negative")))
    papers = v.table(spark, sf_dir, "documents").select(
        F.floor(doc / 3).cast("string").alias("triplet_id"),
        F.element_at(names, (doc % 3 + 1).cast("int")).alias("role"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("abstract"),
    )
    path = fresh_path(spark, "triplets")
    papers.write.partitionBy("role").json(path)
    return cf.read_triplets(spark, path, multi_line=False).select(
        "triplet_id",
        "role",
        v.short("title").alias("title_md5"),
        v.short("abstract").alias("abstract_md5"),
    )
