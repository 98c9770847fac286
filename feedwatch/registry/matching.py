"""Watchlist matching and daily digests."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedwatch.functions import formats as fmt
from feedwatch.functions import text as tx
from feedwatch.operators import match as mt
from feedwatch.operators.many_terms import classify_many_terms
from feedwatch.operators.digest import PER_PART, digest_concat
from feedwatch.plans.daily import daily_digest, nothing_found, render_matches, with_rules
from feedwatch.registry import register
from feedwatch.registry import views as v
from feedwatch.session import durable

KEY = ["rule_pos", "site", "pos"]


def labelled(spark, sf_dir):
    return mt.classify_entries(v.entries(spark, sf_dir), v.watch(spark))


def matched(spark, sf_dir):
    return mt.matched_entries(v.entries(spark, sf_dir), v.watch(spark))


@register(
    "watchlist_defaults",
    "WITH" + v.ENTRIES + "," + v.RULES_SQL + """
SELECT rule_pos, site, array_to_string(authors, '|') AS authors, array_to_string(words, '|') AS words,
       count(pos) AS n_entries
FROM rules LEFT JOIN entries USING (site) GROUP BY ALL""",
)
def watchlist_defaults(spark, sf_dir):
    rules = mt.watchlist_defaults(v.watch(spark))
    sizes = v.entries(spark, sf_dir).groupBy("site").agg(F.count("*").alias("n"))
    return rules.join(sizes, "site", "left").select(
        "rule_pos",
        "site",
        F.array_join("authors", "|").alias("authors"),
        F.array_join("words", "|").alias("words"),
        F.coalesce("n", F.lit(0)).alias("n_entries"),
    )


@register("author_match", v.LABELLED + "SELECT rule_pos, site, pos FROM labelled WHERE by_author")
def author_match(spark, sf_dir):
    joined = mt.entries_with_rules(v.entries(spark, sf_dir), v.watch(spark))
    return joined.where(mt.author_match(F.col("author"), F.col("authors"))).select(*KEY)


@register("title_match", v.LABELLED + "SELECT rule_pos, site, pos FROM labelled WHERE by_title")
def title_match(spark, sf_dir):
    joined = mt.entries_with_rules(v.entries(spark, sf_dir), v.watch(spark))
    return joined.where(mt.word_match(F.col("title"), F.col("forms"))).select(*KEY)


@register("summary_match", v.LABELLED + "SELECT rule_pos, site, pos FROM labelled WHERE by_summary")
def summary_match(spark, sf_dir):
    joined = mt.entries_with_rules(v.entries(spark, sf_dir), v.watch(spark))
    return joined.where(mt.word_match(F.col("summary"), F.col("forms"))).select(*KEY)


@register("classify_entry", v.LABELLED + "SELECT rule_pos, site, pos, match FROM labelled")
def classify_entry(spark, sf_dir):
    return labelled(spark, sf_dir).select(*KEY, "match")


@register("classify_many_terms", v.LABELLED + "SELECT rule_pos, site, pos, match FROM labelled")
def many_terms(spark, sf_dir):
    rows = classify_many_terms(v.entries(spark, sf_dir), v.watch(spark))
    return rows.select(*KEY, "match")


@register("matched_entries", v.LABELLED + "SELECT rule_pos, site, pos, match FROM matched")
def matched_entries(spark, sf_dir):
    return matched(spark, sf_dir).select(*KEY, "match")


@register(
    "split_by_author",
    v.LABELLED + """
SELECT site, CASE WHEN match = 'author' THEN 'author' ELSE 'keyword' END AS kind, count(*) AS n
FROM matched GROUP BY ALL""",
)
def split_by_author(spark, sf_dir):
    kinds = matched(spark, sf_dir).select("site", mt.match_kind("match").alias("kind"))
    return kinds.groupBy("site", "kind").agg(F.count("*").alias("n"))


@register(
    "author_highlight_match",
    v.LABELLED + """
SELECT rule_pos, site, pos,
       CAST(len(list_filter(string_split(author, ', '), lambda n:
         len(list_filter(authors, lambda a: instr(n, a) >= 1)) > 0)) AS INTEGER) AS n_bold
FROM labelled""",
)
def author_highlight_match(spark, sf_dir):
    joined = mt.entries_with_rules(v.entries(spark, sf_dir), v.watch(spark))
    bold = F.filter(tx.split_authors("author"), lambda n: tx.author_hit(n, F.col("authors")))
    return joined.select(*KEY, F.size(bold).alias("n_bold"))


@register(
    "nonempty_digest",
    v.LABELLED + "SELECT rule_pos, site, count(*) AS n_matches FROM matched GROUP BY ALL",
)
def nonempty_digest(spark, sf_dir):
    return matched(spark, sf_dir).groupBy("rule_pos", "site").agg(F.count("*").alias("n_matches"))


@register(
    "entries_x_watchlist",
    v.LABELLED + """
SELECT rule_pos, site, pos, CAST(len(authors) AS INTEGER) AS n_authors, CAST(len(words) AS INTEGER) AS n_words
FROM labelled""",
)
def entries_x_watchlist(spark, sf_dir):
    joined = mt.entries_with_rules(v.entries(spark, sf_dir), v.watch(spark))
    return joined.select(
        *KEY, F.size("authors").alias("n_authors"), F.size("words").alias("n_words")
    )


HITS = v.LABELLED + """,
hits AS (
  SELECT rule_pos, site, pos, 'author' AS field, term
  FROM (SELECT *, unnest(authors) AS term FROM labelled) WHERE instr(author, term) > 1
  UNION ALL
  SELECT rule_pos, site, pos, 'title', term
  FROM (SELECT *, lower(unnest(words)) AS term FROM labelled) WHERE instr(lower(title), term) > 1
  UNION ALL
  SELECT rule_pos, site, pos, 'summary', term
  FROM (SELECT *, lower(unnest(words)) AS term FROM labelled) WHERE instr(lower(summary), term) > 1)"""


@register("entries_x_terms", HITS + " SELECT rule_pos, site, pos, field, term FROM hits")
def entries_x_terms(spark, sf_dir):
    hits = mt.term_hits(v.entries(spark, sf_dir), v.watch(spark))
    return hits.select(*KEY, "field", "term")


@register(
    "any_term",
    HITS + """
SELECT rule_pos, site, pos,
       CASE WHEN bool_or(field = 'author') THEN 'author' WHEN bool_or(field = 'title') THEN 'title'
            ELSE 'summary' END AS match
FROM hits GROUP BY ALL""",
)
def any_term(spark, sf_dir):
    return mt.any_term(mt.term_hits(v.entries(spark, sf_dir), v.watch(spark)), KEY)


@register(
    "sites_without_matches",
    v.LABELLED + """
SELECT rule_pos, site FROM rules WHERE rule_pos NOT IN (SELECT rule_pos FROM matched)""",
)
def sites_without_matches(spark, sf_dir):
    found = mt.sites_without_matches(v.watch(spark), matched(spark, sf_dir))
    return found.select("rule_pos", "site")


@register(
    "all_sites_empty",
    v.LABELLED + """
SELECT count(*) AS n_rules, count(*) FILTER (n IS NULL) AS n_empty,
       count(*) = count(*) FILTER (n IS NULL) AS all_empty
FROM rules LEFT JOIN (SELECT rule_pos, count(*) AS n FROM matched GROUP BY 1) USING (rule_pos)""",
)
def all_sites_empty(spark, sf_dir):
    return mt.all_sites_empty(v.watch(spark), matched(spark, sf_dir))


_ABSENT = "no-such-word"


@register(
    "nothing_found_notice",
    "WITH" + v.ENTRIES + f"""
SELECT '{fmt.NOTHING_FOUND}' AS subject, '<b>{fmt.NOTHING_FOUND}</b>' AS html, '{fmt.NOTHING_FOUND}' AS plain
FROM (SELECT count(*) FILTER (instr(author, '{_ABSENT}') > 1 OR instr(lower(title), '{_ABSENT}') > 1
                              OR instr(lower(summary), '{_ABSENT}') > 1) AS n FROM entries)
WHERE n = 0""",
)
def nothing_found_notice(spark, sf_dir):
    """A watchlist of every source with terms that occur nowhere gives the global notice."""
    terms = F.array(F.lit(_ABSENT))
    watch = v.watch(spark).withColumns({"authors": terms, "words": terms})
    found = mt.matched_entries(v.entries(spark, sf_dir), watch)
    return nothing_found(watch, found).select("subject", "html", "plain")


@register(
    "feed_counts",
    v.LABELLED + """
SELECT rule_pos, site, count(*) AS n_entries, count(*) FILTER (match <> '') AS n_matches
FROM labelled GROUP BY ALL""",
)
def feed_counts(spark, sf_dir):
    return mt.feed_counts(v.entries(spark, sf_dir), v.watch(spark))


@register(
    "saved_match_row",
    v.LABELLED + """
SELECT rule_pos, site, match, pos, md5(title) AS title_md5, link, published,
       DATE '2026-12-06' AS append_date, DATE '2026-11-30' AS week
FROM matched""",
)
def saved_match_row(spark, sf_dir):
    rows = mt.saved_match_row(matched(spark, sf_dir), F.lit(v.RUN_DATE))
    return rows.select(
        "rule_pos",
        "site",
        "match",
        "entry.pos",
        v.short("entry.title").alias("title_md5"),
        "entry.link",
        "entry.published",
        "append_date",
        "week",
    )


# ---------------------------------------------------------------- rendering and digests

AUTHOR_LINE = """
CASE WHEN match = 'author' THEN array_to_string(list_transform(string_split(author, ', '), lambda n:
  CASE WHEN len(list_filter(authors, lambda a: instr(n, a) >= 1)) > 0 THEN '<b>' || n || '</b>' ELSE n END), ' , ')
  || ' ' ELSE array_to_string(string_split(author, ', '), ', ') END"""


def rendered_sql(source: str) -> str:
    return f"""
rendered AS (
  SELECT *, '<div><p style="color:blue;font-size:1.17em;"><b><a href="' || link || '">'
    || {v.wrap_sql("title", "words", fmt.TITLE_TAGS)} || '</a></b></p><p><i>' || {AUTHOR_LINE}
    || '<i></p><br><p>' || {v.wrap_sql(v.body_sql("summary"), "words", fmt.BOLD_TAGS)}
    || '</p><br><br></div>' AS html,
    title || chr(10) || ' ' || chr(9) || author || chr(10) || ' ' || chr(10) || {v.body_sql("summary")}
    || chr(10) || ' ' || chr(10) AS plain
  FROM {source})"""


MARKED_MATCHES = "WITH" + v.MARKED + "," + v.RULES_SQL + "," + v.labelled_sql("marked")


@register(
    "bold_authors",
    v.LABELLED + f"SELECT rule_pos, site, pos, {AUTHOR_LINE} AS author_line FROM labelled",
)
def bold_authors(spark, sf_dir):
    line = tx.bold_authors("author", "match", F.col("authors"))
    return labelled(spark, sf_dir).select(*KEY, line.alias("author_line"))


@register(
    "render_entry",
    MARKED_MATCHES + "," + rendered_sql("matched") + """
SELECT rule_pos, site, pos, md5(html) AS html_md5, length(html) AS html_len, md5(plain) AS plain_md5
FROM rendered""",
)
def render_entry(spark, sf_dir):
    found = mt.matched_entries(v.marked(spark, sf_dir), v.watch(spark))
    return render_matches(found, KEY).select(
        *KEY,
        v.short("html").alias("html_md5"),
        F.length("html").cast("bigint").alias("html_len"),
        v.short("plain").alias("plain_md5"),
    )


def digest_columns(digests):
    """Digests compared by hash and length."""
    long = {
        "html_md5": v.short("html"),
        "html_len": F.length("html").cast("bigint"),
        "plain_md5": v.short("plain"),
    }
    return digests.withColumns(long).drop("html", "plain")


_HEAD, _FOOT = v.sql_text(fmt.MATCH_HEADER), v.sql_text(fmt.MATCH_FOOTER)


def parts_sql(
    source: str, keys: str, order: str, per_part: int, head: str, foot: str, plain_head: str = "''"
) -> str:
    """Digest parts in SQL: buckets of positions fill parts in order; ``order`` ends with ``pos``."""
    by = f"{keys}, {order.removesuffix('pos')}bucket"
    return f""",
bucketed AS (SELECT *, pos // {per_part} AS bucket FROM {source}),
spans AS (SELECT {by}, count(*) AS n FROM bucketed GROUP BY {by}),
slots AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY {keys} ORDER BY {by}
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {per_part} AS slot
  FROM spans),
numbered AS (
  SELECT *, dense_rank() OVER (PARTITION BY {keys} ORDER BY slot) - 1 AS part,
         (sum(n) OVER (PARTITION BY {keys}))::BIGINT AS n_entries
  FROM slots),
counted AS (SELECT *, max(part) OVER (PARTITION BY {keys}) + 1 AS n_parts FROM numbered),
parts AS (
  SELECT {keys}, part, n_parts, n_entries,
         CASE WHEN part = 0 THEN {head} ELSE '' END || string_agg(html, '' ORDER BY {order})
           || CASE WHEN part = n_parts - 1 THEN {foot} ELSE '' END AS html,
         CASE WHEN part = 0 THEN {plain_head} ELSE '' END || string_agg(plain, '' ORDER BY {order}) AS plain
  FROM bucketed JOIN (SELECT {by}, part, n_parts, n_entries FROM counted) USING ({by})
  GROUP BY {keys}, part, n_parts, n_entries)"""


DIGEST_SQL = """
SELECT DATE '2026-12-06' AS run_date, {pos} AS config_pos, site, '{kind}' AS kind, part, n_parts,
       {subject} AS subject, n_entries, md5(html) AS html_md5, length(html) AS html_len, md5(plain) AS plain_md5
FROM parts"""


def matches_parts(per_part: int) -> str:
    return parts_sql("rendered", "rule_pos, site", "pos", per_part, _HEAD, _FOOT)


def _concat(spark, sf_dir, **bounds):
    found = mt.matched_entries(v.marked(spark, sf_dir), v.watch(spark))
    keys = ["rule_pos", "site"]
    found = durable(
        found.select(*keys, "match", "pos", "title", "author", "summary", "link"), "matches"
    )
    parts = digest_concat(
        found,
        keys,
        ["pos"],
        lambda placed, keep: render_matches(with_rules(placed, v.watch(spark)), keep),
        F.lit(fmt.MATCH_HEADER),
        F.lit(fmt.MATCH_FOOTER),
        **bounds,
    )
    return digest_columns(parts)


@register(
    "digest_concat",
    MARKED_MATCHES + "," + rendered_sql("matched") + matches_parts(8) + """
SELECT rule_pos, site, part, n_parts, n_entries, md5(html) AS html_md5, length(html) AS html_len,
       md5(plain) AS plain_md5
FROM parts""",
)
def concat_query(spark, sf_dir):
    """Digests cut into parts of eight entries and more."""
    return _concat(spark, sf_dir, per_part=8)


@register(
    "digest_by_bytes",
    MARKED_MATCHES + "," + rendered_sql("matched") + f""",
sized AS (
  SELECT *, pos // 8 AS bucket,
         coalesce(strlen(site), 0) + coalesce(strlen(match), 0) + coalesce(strlen(title), 0) + coalesce(strlen(author), 0)
         + coalesce(strlen(summary), 0) + coalesce(strlen(link), 0) AS size
  FROM rendered),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY rule_pos ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS above,
         row_number() OVER (PARTITION BY rule_pos ORDER BY pos) - 1 AS place
  FROM sized),
slots AS (SELECT *, (min(place) OVER (PARTITION BY rule_pos, bucket)) // 8 AS slot, above // 6000 AS weight FROM summed),
numbered AS (
  SELECT *, dense_rank() OVER (PARTITION BY rule_pos ORDER BY slot, weight) - 1 AS part, count(*) OVER (PARTITION BY rule_pos) AS n_entries
  FROM slots),
counted AS (SELECT *, max(part) OVER (PARTITION BY rule_pos) + 1 AS n_parts FROM numbered),
parts AS (
  SELECT rule_pos, site, part, n_parts, n_entries,
         CASE WHEN part = 0 THEN {_HEAD} ELSE '' END || string_agg(html, '' ORDER BY pos)
           || CASE WHEN part = n_parts - 1 THEN {_FOOT} ELSE '' END AS html,
         string_agg(plain, '' ORDER BY pos) AS plain
  FROM counted GROUP BY rule_pos, site, part, n_parts, n_entries)
SELECT rule_pos, site, part, n_parts, n_entries, md5(html) AS html_md5, length(html) AS html_len, md5(plain) AS plain_md5
FROM parts""",
)
def digest_by_bytes(spark, sf_dir):
    """Parts bounded by text too: a part ends where the next 6,000 bytes of the site begin."""
    return _concat(spark, sf_dir, per_part=8, part_bytes=6000)


@register(
    "daily_digest",
    MARKED_MATCHES + "," + rendered_sql("matched") + matches_parts(PER_PART) + DIGEST_SQL.format(
        pos="rule_pos", kind="daily", subject="'Filtered Arxiv ' || site"
    ),
)
def daily(spark, sf_dir):
    return digest_columns(daily_digest(v.marked(spark, sf_dir), v.watch(spark), v.RUN_DATE))
