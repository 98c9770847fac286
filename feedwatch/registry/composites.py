"""Composite similarity queries on text, triplets and bulk metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedwatch.functions import formats as fmt
from feedwatch.functions import text as tx
from feedwatch.operators import records as rc
from feedwatch.operators import similarity as sim
from feedwatch.operators.digest import PER_PART
from feedwatch.plans import similar as plan
from feedwatch.plans.metadata import metadata_table
from feedwatch.plans.triplets import triplet_eval, triplet_rows
from feedwatch.registry import register
from feedwatch.registry import views as v
from feedwatch.registry.matching import DIGEST_SQL, digest_columns, parts_sql
from feedwatch.registry.similarity import attached

PAIR = ["site", "target_pos", "pos"]
WITH = "WITH" + v.TEXT_PAIRS
SET = v.TEXT_SETTINGS


def targets_of(spark, sf_dir):
    return plan.encode_targets(attached(spark, sf_dir))


def pairs_of(spark, sf_dir, targets):
    return plan.similar_papers(v.delivered(spark, sf_dir), targets, SET)


@register(
    "similar_papers",
    WITH + """
SELECT site, target_pos, pos, round(title_similarity, 6) AS title_similarity,
       round(top_k_score, 6) AS top_k_score
FROM similar_pairs""",
)
def similar_papers(spark, sf_dir):
    pairs = pairs_of(spark, sf_dir, targets_of(spark, sf_dir))
    return pairs.select(
        *PAIR,
        F.round("title_similarity", 6).alias("title_similarity"),
        F.round("top_k_score", 6).alias("top_k_score"),
    )


ATTRIBUTES = WITH + """,
attributes AS (
  SELECT p.site, p.target_pos, p.pos, t.search_pos, e.title, e.summary, e.id,
         t.title AS target_title, t.summary AS target_summary, t.paper_url AS target_link
  FROM similar_pairs p JOIN entry_titles e USING (pos) JOIN text_targets t USING (target_pos))"""


def attributes(spark, sf_dir):
    targets = targets_of(spark, sf_dir)
    return plan.pair_attributes(pairs_of(spark, sf_dir, targets), targets)


def _attribute_row(spark, sf_dir):
    return attributes(spark, sf_dir).select(
        *PAIR,
        v.short("title").alias("title_md5"),
        v.short("summary").alias("summary_md5"),
        "id",
        v.short("target_title").alias("target_title_md5"),
        v.short("target_summary").alias("target_summary_md5"),
        "target_link",
    )


_ATTRIBUTE_SQL = ATTRIBUTES + """
SELECT site, target_pos, pos, md5(title) AS title_md5, md5(summary) AS summary_md5, id,
       md5(target_title) AS target_title_md5, md5(target_summary) AS target_summary_md5, target_link
FROM attributes"""


@register("pair_lookup", _ATTRIBUTE_SQL)
def pair_lookup(spark, sf_dir):
    return _attribute_row(spark, sf_dir)


@register(
    "pair_attributes",
    ATTRIBUTES + """
SELECT site, search_pos, target_pos, pos, length(summary) AS n_summary, length(target_summary) AS n_target
FROM attributes""",
)
def pair_attributes(spark, sf_dir):
    return attributes(spark, sf_dir).select(
        "site",
        "search_pos",
        "target_pos",
        "pos",
        F.length("summary").cast("bigint").alias("n_summary"),
        F.length("target_summary").cast("bigint").alias("n_target"),
    )


def _pair_sql() -> str:
    html = fmt.PAIR_TEMPLATE.replace("%%", "%")
    pieces = v.sql_text(html)
    for n, name in enumerate(["title", "summary", "id", "target_title", "target_summary", "target_link"]):
        pieces = pieces.replace(f"%{n + 1}$s", f"' || {name} || '")
    plain = "title || chr(10) || summary || chr(10) || target_title || chr(10) || target_summary"
    return f""",
rendered AS (SELECT *, {pieces} AS html, {plain} AS plain FROM attributes)"""


@register(
    "render_pair",
    ATTRIBUTES + _pair_sql() + """
SELECT target_pos, pos, md5(html) AS html_md5, md5(plain) AS plain_md5 FROM rendered""",
)
def render_pair(spark, sf_dir):
    sides = ("title", "summary", "id", "target_title", "target_summary", "target_link")
    rows = attributes(spark, sf_dir).select(
        "target_pos",
        "pos",
        tx.render_pair_html(*sides).alias("html"),
        tx.render_pair_text(*(sides[n] for n in (0, 1, 3, 4))).alias("plain"),
    )
    return rows.select(
        "target_pos", "pos", v.short("html").alias("html_md5"), v.short("plain").alias("plain_md5")
    )


@register(
    "similarity_digest",
    ATTRIBUTES + _pair_sql() + parts_sql(
        "rendered", "search_pos, site", "target_pos, pos", PER_PART,
        f"{v.sql_text(fmt.SIMILARITY_HEADER)} || '<h1> Similarity Results for ' || site || '</h1>'",
        v.sql_text(fmt.SIMILARITY_FOOTER), "'Similarity Results for ' || site || chr(10)",
    ) + DIGEST_SQL.format(
        pos="CAST(search_pos AS BIGINT)", kind="similarity",
        subject="'Similarity Filter for Arxiv ' || site",
    ),
)
def similarity_digest(spark, sf_dir):
    targets = targets_of(spark, sf_dir)
    digests = plan.similarity_digest(pairs_of(spark, sf_dir, targets), targets, v.RUN_DATE)
    return digest_columns(digests)


@register(
    "top_k_sentence_report",
    WITH + """
SELECT target_pos, pos, rank, i::INTEGER AS i, j::INTEGER AS j, round(similarity, 6) AS score, md5(target_sentence) AS target_md5,
       md5(entry_sentence) AS entry_md5
FROM ranked WHERE rank <= 4""",
)
def top_k_sentence_report(spark, sf_dir):
    """The best sentence pairs of every pair whose titles are close, with both sentences."""
    rows = plan.sentence_report(v.delivered(spark, sf_dir), targets_of(spark, sf_dir), SET, 4)
    return rows.select(
        "target_pos",
        "pos",
        F.col("rank").cast("bigint").alias("rank"),
        "i",
        "j",
        F.round("similarity", 6).alias("score"),
        F.md5("target_sentence").alias("target_md5"),
        F.md5("entry_sentence").alias("entry_md5"),
    )


# ---------------------------------------------------------------- triplets

_ROLES = ["anchor", "positive", "negative"]


def triplet_papers(spark, sf_dir):
    """Three neighbouring papers make a triplet; an incomplete one at the end is left out."""
    role = F.element_at(F.array(*(F.lit(r) for r in _ROLES)), (F.col("pos") % 3 + 1).cast("int"))
    return v.papers(spark, sf_dir).select(
        F.floor(F.col("pos") / 3).alias("triplet_id"), role.alias("role"), "title_vec", "sent_vecs"
    )


TRIPLETS = "WITH" + v.VECTORS + """,
roles AS (SELECT pos // 3 AS triplet_id, pos % 3 AS role, pos, title_vec FROM papers),
others AS (
  SELECT a.triplet_id, o.role, a.pos AS anchor, o.pos AS other,
         list_cosine_similarity(a.title_vec, o.title_vec) AS title_similarity
  FROM roles a JOIN roles o ON a.triplet_id = o.triplet_id AND a.role = 0 AND o.role > 0),
sims AS (
  SELECT triplet_id, role, a.sent_pos AS i, max(list_cosine_similarity(a.vec, b.vec)) AS similarity
  FROM others JOIN sents a ON a.paper = anchor JOIN sents b ON b.paper = other GROUP BY ALL),
top AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY triplet_id, role ORDER BY similarity DESC, i) <= 4),
role_scores AS (
  SELECT triplet_id, role, sum(similarity) / 4 AS score, any_value(title_similarity) AS title_similarity
  FROM top JOIN others USING (triplet_id, role) GROUP BY ALL),
triplets AS (
  SELECT p.triplet_id, p.title_similarity AS title_positive, n.title_similarity AS title_negative,
         p.score AS score_positive, n.score AS score_negative, p.score - n.score AS margin
  FROM role_scores p JOIN role_scores n ON p.triplet_id = n.triplet_id AND p.role = 1 AND n.role = 2)"""


@register(
    "triplet_eval",
    TRIPLETS + """
SELECT triplet_id, round(title_positive, 6) AS title_positive, round(title_negative, 6) AS title_negative,
       round(score_positive, 6) AS score_positive, round(score_negative, 6) AS score_negative,
       round(margin, 6) + 0 AS margin
FROM triplets""",
)
def triplets(spark, sf_dir):
    scored = triplet_eval(triplet_papers(spark, sf_dir))
    names = ["title_positive", "title_negative", "score_positive", "score_negative"]
    return scored.select(
        "triplet_id",
        *(F.round(n, 6).alias(n) for n in names),
        (F.round("margin", 6) + 0).alias("margin"),
    )


@register(
    "triplet_accuracy",
    TRIPLETS + """
SELECT count(*) AS n_triplets, round(avg(CAST(margin > 0 AS DOUBLE)), 6) AS accuracy,
       round(avg(margin), 6) + 0 AS mean_margin
FROM triplets""",
)
def triplet_accuracy(spark, sf_dir):
    total = sim.triplet_accuracy(sim.triplet_scores(triplet_rows(triplet_papers(spark, sf_dir))))
    return total.select(
        "n_triplets",
        F.round("accuracy", 6).alias("accuracy"),
        (F.round("mean_margin", 6) + 0).alias("mean_margin"),
    )


# ---------------------------------------------------------------- bulk metadata

OAI = "WITH" + v.RECORDS
_DATES = "list_transform(range(1, n_versions + 1), lambda n: {0})"


def parsed(spark, sf_dir):
    return rc.parse_pages(v.record_pages(spark, sf_dir))


@register("oai_error_check", """
SELECT 'error-' || lang AS page_id, 'nothing for ' || lang AS error FROM documents GROUP BY lang""")
def oai_error_check(spark, sf_dir):
    return rc.page_errors(parsed(spark, sf_dir)).select("page_id", "error")


@register(
    "oai_rejects",
    """
SELECT 'cut-' || page_id AS page_id FROM pages
UNION ALL SELECT DISTINCT 'half-' || source || '-' || (doc_id // 100) FROM documents""",
)
def oai_rejects(spark, sf_dir):
    """Web pages among the pages, and pages of records cut off half way: none is lost silently."""
    good = v.record_pages(spark, sf_dir)
    lists = good.where(~F.col("page_id").startswith("error-"))
    half = lists.withColumns({"page_id": F.concat(F.lit("half-"), "page_id"), "xml": F.expr("left(xml, length(xml) div 2)")})
    web = v.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("cut-"), F.col("page_id").cast("string")).alias("page_id"), F.lit("none").alias("set_name"), F.col("html").alias("xml")
    )
    pages = rc.parse_pages(good.unionByName(half).unionByName(web))
    return rc.page_rejects(pages).select("page_id")


@register(
    "oai_records",
    OAI + """
SELECT page_id, CASE WHEN page_id LIKE '%0' THEN page_id ELSE '' END AS token, count(*) AS n_records
FROM records GROUP BY page_id
UNION ALL SELECT 'error-' || lang, '', 0 FROM documents GROUP BY lang""",
)
def oai_records(spark, sf_dir):
    """Records per page and the page's continuation token."""
    pages = rc.page_tokens(
        parsed(spark, sf_dir).withColumn("n", F.size("page.ListRecords.record"))
    )
    n = F.greatest(F.coalesce("n", F.lit(0)), F.lit(0)).cast("bigint")
    return pages.select("page_id", "token", n.alias("n_records"))


@register(
    "oai_flatten",
    OAI + f"""
SELECT id, submitter, authors, md5(title) AS title_md5, comments, NULL::VARCHAR AS journal_ref,
       NULL::VARCHAR AS doi, md5(abstract) AS abstract_md5, NULL::VARCHAR AS report_no, categories,
       array_to_string({_DATES.format("'v' || n")}, ',') AS versions,
       array_to_string({_DATES.format("'day ' || n")}, ',') AS versions_dates
FROM records""",
)
def oai_flatten(spark, sf_dir):
    flat = rc.flatten_records(rc.page_records(parsed(spark, sf_dir)))
    return flat.select(
        "id",
        "submitter",
        "authors",
        v.short("title").alias("title_md5"),
        "comments",
        F.col("`journal-ref`").alias("journal_ref"),
        "doi",
        v.short("abstract").alias("abstract_md5"),
        F.col("`report-no`").alias("report_no"),
        F.array_join("categories", ",").alias("categories"),
        F.array_join("versions", ",").alias("versions"),
        F.array_join("versions_dates", ",").alias("versions_dates"),
    )


@register(
    "xml_leaf_text",
    OAI + """
SELECT id, comments IS NULL AS no_comments, TRUE AS no_doi, length(abstract) AS n_abstract FROM records""",
)
def xml_leaf_text(spark, sf_dir):
    """Absent leaves are null and present ones keep their text, blanks included."""
    raw = rc.page_records(parsed(spark, sf_dir))
    return raw.select(
        "id",
        F.isnull("comments").alias("no_comments"),
        F.isnull("doi").alias("no_doi"),
        F.length("abstract").cast("bigint").alias("n_abstract"),
    )


@register(
    "oai_versions_history",
    OAI + """
SELECT id, CAST(n - 1 AS INTEGER) AS version_pos, 'v' || n AS version, 'day ' || n AS version_date,
       n = n_versions AS is_latest
FROM (SELECT id, n_versions, unnest(range(1, n_versions + 1)) AS n FROM records)""",
)
def oai_versions_history(spark, sf_dir):
    return rc.version_history(rc.flatten_records(rc.page_records(parsed(spark, sf_dir))))


@register(
    "oai_metadata_table",
    OAI + """
SELECT site, count(*) AS n_records, CAST(sum(n_versions) AS BIGINT) AS n_versions, count(comments) AS n_comments
FROM records GROUP BY site""",
)
def oai_metadata_table(spark, sf_dir):
    table = metadata_table(v.record_pages(spark, sf_dir), "set_name")
    return table.groupBy("site").agg(
        F.count("*").alias("n_records"),
        F.sum(F.size("versions")).alias("n_versions"),
        F.count("comments").alias("n_comments"),
    )
