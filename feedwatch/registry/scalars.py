"""Scalar functions on the document, page and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedwatch.functions import formats as fmt
from feedwatch.functions import html as hm
from feedwatch.functions import text as tx
from feedwatch.functions.vectors import cosine_similarity, encode_sentences, masked_mean_pool_rows
from feedwatch.operators import match as mt
from feedwatch.registry import register
from feedwatch.registry import views as v

WITH_MARKED = "WITH" + v.MARKED
WITH_ENTRIES = "WITH" + v.ENTRIES
WATCHED = "WITH" + v.MARKED + "," + v.RULES_SQL + """,
watched AS (SELECT * FROM marked JOIN rules USING (site))"""


def watched(spark, sf_dir):
    return mt.entries_with_rules(v.marked(spark, sf_dir), v.watch(spark))


@register(
    "arxiv_title_clean",
    WITH_MARKED + f"""
SELECT pos, {v.strip_sql("CASE WHEN instr(title, '(arXiv:') = 0 THEN left(title, greatest(length(title) - 1, 0)) ELSE left(title, instr(title, '(arXiv:') - 1) END")} AS title
FROM marked""",
)
def arxiv_title_clean(spark, sf_dir):
    return v.marked(spark, sf_dir).select("pos", tx.arxiv_title_clean("title").alias("title"))


@register(
    "newline_to_space",
    "SELECT doc_id, md5(replace(text, chr(10), ' ')) AS text_md5 FROM documents",
)
def newline_to_space(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    return docs.select("doc_id", v.short(tx.newline_to_space("text")).alias("text_md5"))


def _html_sql() -> str:
    """Written step by step and apart from the operator: what is hidden, then tags, then entities."""
    text = "html"
    for hidden in ("<!--.*?-->", "<script.*?</script>", "<style.*?</style>", "<template.*?</template>", "<[!?/A-Za-z][^>]*>"):
        text = f"regexp_replace({text}, '{hidden}', '', 'gsi')"
    named = {"lt": "<", "gt": ">", "quot": '"', "apos": "''", "#39": "''", "#x27": "''", "nbsp": "\u00a0", "copy": "©", "mdash": "—",
             "hellip": "…", "middot": "·"}
    for name, char in named.items():
        text = f"replace({text}, '&{name};', '{char}')"
    text = f"replace(replace({text}, '&amp;', '&'), chr(10), ' ')"
    return f"SELECT page_id, md5({text}) AS text_md5, length({text}) AS n_chars FROM pages"


def _page_texts(spark, sf_dir, text):
    rows = v.table(spark, sf_dir, "pages").select("page_id", text.alias("t"))
    return rows.select(
        "page_id", v.short("t").alias("text_md5"), F.length("t").cast("bigint").alias("n_chars")
    )


@register("html_to_text", _html_sql())
def html_to_text(spark, sf_dir):
    return _page_texts(spark, sf_dir, hm.html_to_text("html"))


@register("html_to_text_sql", _html_sql())
def html_to_text_sql(spark, sf_dir):
    return _page_texts(spark, sf_dir, hm.html_to_text_sql("html"))


@register(
    "arxiv_id_from_link",
    "SELECT page_id, url, string_split(url, '/')[-1] AS last_part FROM pages",
)
def arxiv_id_from_link(spark, sf_dir):
    pages = v.table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", tx.arxiv_id_from_link("url").alias("last_part"))


@register(
    "abstract_body", WITH_MARKED + f"SELECT pos, md5({v.body_sql('summary')}) AS body_md5 FROM marked"
)
def abstract_body(spark, sf_dir):
    body = v.short(tx.abstract_body("summary"))
    return v.marked(spark, sf_dir).select("pos", body.alias("body_md5"))


@register(
    "split_authors",
    WITH_ENTRIES + """
SELECT pos, CAST(len(string_split(author, ', ')) AS INTEGER) AS n_authors, author AS joined FROM entries""",
)
def split_authors(spark, sf_dir):
    names = tx.split_authors("author")
    return v.entries(spark, sf_dir).select(
        "pos", F.size(names).alias("n_authors"), tx.join_authors(names).alias("joined")
    )


@register(
    "strip_anchor",
    WITH_ENTRIES + """,
anchors AS (SELECT pos, CASE WHEN pos % 3 = 0 THEN '<a href="' || link || '">' || author || '</a>'
                             WHEN pos % 3 = 1 THEN author || '</a>' ELSE author END AS a FROM entries),
marks AS (SELECT *, instr(a, '">') AS b, instr(a, '</a>') AS e FROM anchors)
SELECT pos, CASE WHEN n > 0 THEN substr(a, b + 2, n) ELSE '' END AS name
FROM (SELECT *, (CASE WHEN e = 0 THEN length(a) ELSE e END) - 1 - (b + 1) AS n FROM marks)""",
)
def strip_anchor(spark, sf_dir):
    rest = F.col("pos") % 3
    anchor = (
        F.when(rest == 0, F.concat(F.lit('<a href="'), "link", F.lit('">'), "author", F.lit("</a>")))
        .when(rest == 1, F.concat("author", F.lit("</a>")))
        .otherwise(F.col("author"))
    )
    return v.entries(spark, sf_dir).select("pos", tx.strip_anchor(anchor).alias("name"))


@register(
    "wrap_words",
    WATCHED + f"""
SELECT rule_pos, pos, md5({v.wrap_sql("title", "words", fmt.TITLE_TAGS)}) AS html_md5 FROM watched""",
)
def wrap_words(spark, sf_dir):
    html = tx.wrap_words("title", F.col("forms"), fmt.TITLE_TAGS)
    return watched(spark, sf_dir).select("rule_pos", "pos", v.short(html).alias("html_md5"))


@register(
    "bold_words",
    WATCHED + f"""
SELECT rule_pos, pos, md5({v.wrap_sql("summary", "words", fmt.BOLD_TAGS)}) AS html_md5 FROM watched""",
)
def bold_words(spark, sf_dir):
    html = tx.bold_words("summary", F.col("forms"))
    return watched(spark, sf_dir).select("rule_pos", "pos", v.short(html).alias("html_md5"))


@register(
    "py_capitalize",
    f"SELECT doc_id, md5({v.capital_sql('text')}) AS text_md5 FROM documents",
)
def py_capitalize(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    return docs.select("doc_id", v.short(tx.py_capitalize("text")).alias("text_md5"))


@register("py_title", f"SELECT doc_id, md5({v.title_sql('text')}) AS text_md5 FROM documents")
def py_title(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    return docs.select("doc_id", v.short(tx.py_title("text")).alias("text_md5"))


@register("html_escape", f"SELECT page_id, md5({v.escape_sql('html')}) AS html_md5 FROM pages")
def html_escape(spark, sf_dir):
    pages = v.table(spark, sf_dir, "pages")
    return pages.select("page_id", v.short(tx.html_escape("html")).alias("html_md5"))


@register(
    "match_to_text",
    v.LABELLED + """
SELECT rule_pos, pos, CASE match WHEN 'author' THEN 1 WHEN 'title' THEN 2 WHEN 'summary' THEN 3 ELSE 4 END AS code,
       match AS label
FROM labelled""",
)
def match_to_text(spark, sf_dir):
    rows = mt.classify_entries(v.entries(spark, sf_dir), v.watch(spark))
    coded = rows.select("rule_pos", "pos", tx.text_to_match("match").alias("code"))
    return coded.withColumn("label", tx.match_to_text("code"))


@register(
    "feed_path",
    WITH_ENTRIES + """
SELECT site, 'https://rss.arxiv.org/rss/' || site AS daily, 'http://export.arxiv.org/rss/' || site || '/new' AS newest,
       count(*) AS n_entries
FROM entries GROUP BY site""",
)
def feed_path(spark, sf_dir):
    sites = v.entries(spark, sf_dir).groupBy("site").agg(F.count("*").alias("n_entries"))
    return sites.select(
        "site",
        tx.feed_path("site").alias("daily"),
        tx.feed_path("site", fmt.SIMILARITY_FEED_BASE, fmt.NEW_SUFFIX).alias("newest"),
        "n_entries",
    )


_SITE_CASE = """CASE WHEN lang = 'en' THEN 'cs' WHEN lang = 'de' THEN ' math ' WHEN lang = 'fr' THEN 'q-bio'
            ELSE source END"""


@register(
    "watchlist_sets",
    f"""
WITH named AS (SELECT {_SITE_CASE} AS site FROM documents)
SELECT site, CASE WHEN site IN ('cs', 'econ', 'eess', 'math', 'q-bio', 'q-fin', 'stat') THEN trim(site)
                  ELSE 'physics:' || trim(site) END AS set_name, count(*) AS n
FROM named GROUP BY site""",
)
def watchlist_sets(spark, sf_dir):
    named = v.table(spark, sf_dir, "documents").select(F.expr(_SITE_CASE).alias("site"))
    counted = named.groupBy("site").agg(F.count("*").alias("n"))
    return counted.select("site", tx.watchlist_set("site").alias("set_name"), "n")


@register(
    "set_to_site",
    "SELECT doc_id, lang || ':' || source AS set_name, source AS site FROM documents",
)
def set_to_site(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    sets = docs.select("doc_id", F.concat("lang", F.lit(":"), "source").alias("set_name"))
    return sets.withColumn("site", tx.set_to_site("set_name"))


@register(
    "sentence_split",
    f"""
SELECT doc_id, len(ss)::INTEGER AS n_sentences, md5(array_to_string(ss, '|')) AS sentences_md5
FROM (SELECT doc_id, {v.sentences_sql("text")} AS ss FROM documents)""",
)
def sentence_split(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", tx.sentence_split("text").alias("ss"))
    return rows.select(
        "doc_id",
        F.size("ss").alias("n_sentences"),
        v.short(F.array_join("ss", "|")).alias("sentences_md5"),
    )


@register(
    "cosine_similarity",
    "WITH" + v.VECTORS + """
SELECT paper, a.sent_pos, round(list_cosine_similarity(a.vec, b.vec), 6) AS similarity
FROM sents a JOIN (SELECT paper, vec FROM sents WHERE sent_pos = 0) b USING (paper)""",
)
def cosine_query(spark, sf_dir):
    """Every sentence vector against the title vector of its paper."""
    rows = v.papers(spark, sf_dir).select(
        F.col("pos").alias("paper"), "title_vec", F.posexplode("sent_vecs").alias("sent_pos", "vec")
    )
    value = F.round(cosine_similarity("vec", "title_vec"), 6)
    return rows.select("paper", "sent_pos", value.alias("similarity"))


@register("weekday", "SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS weekday FROM events")
def weekday(spark, sf_dir):
    events = v.table(spark, sf_dir, "events")
    return events.select("event_id", F.weekday("ts").alias("weekday"))


@register(
    "flush_day",
    """
SELECT CAST(ts AS DATE) AS run_date, count(*) AS n FROM events WHERE isodow(ts) = 7 GROUP BY 1""",
)
def flush_day(spark, sf_dir):
    days = v.table(spark, sf_dir, "events").select(F.to_date("ts").alias("run_date"))
    return days.where(tx.is_flush_day("run_date")).groupBy("run_date").agg(F.count("*").alias("n"))


@register(
    "subject_line",
    v.LABELLED + """
SELECT site, 'Filtered Arxiv ' || site AS daily, 'Similarity Filter for Arxiv ' || site AS similarity,
       CASE WHEN count(*) FILTER (match = 'author') > 0 THEN 'Filtered author matches for ' || site
            ELSE 'No author matches found for ' || site || ' arxiv topic' END AS weekly_author,
       CASE WHEN count(*) FILTER (match IN ('title', 'summary')) > 0 THEN 'Filtered matches for ' || site
            ELSE 'No keyword matches found for ' || site || ' arxiv topic' END AS weekly_keyword
FROM labelled GROUP BY site""",
)
def subject_line(spark, sf_dir):
    rows = mt.classify_entries(v.entries(spark, sf_dir), v.watch(spark))
    counts = rows.groupBy("site").agg(
        F.count_if(F.col("match") == "author").alias("a"),
        F.count_if(F.col("match").isin("title", "summary")).alias("k"),
    )
    return counts.select(
        "site",
        tx.daily_subject("site").alias("daily"),
        tx.similarity_subject("site").alias("similarity"),
        tx.weekly_subject("site", F.lit("author"), F.col("a") > 0).alias("weekly_author"),
        tx.weekly_subject("site", F.lit("keyword"), F.col("k") > 0).alias("weekly_keyword"),
    )


@register(
    "ordinals",
    f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS sent_pos, md5(s) AS sentence_md5
FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i
      FROM (SELECT doc_id, {v.sentences_sql("text")} AS ss FROM documents))""",
)
def ordinals(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(tx.sentence_split("text")).alias("sent_pos", "s"))
    return rows.select("doc_id", "sent_pos", v.short("s").alias("sentence_md5"))


@register(
    "sentence_counts",
    f"""
SELECT 'documents' AS role, doc_id AS id, CAST(len({v.sentences_sql("text")}) AS INTEGER) AS n_sentences FROM documents
UNION ALL
SELECT 'benchmark', item_id, CAST(len({v.sentences_sql("text")}) AS INTEGER) FROM benchmark""",
)
def sentence_counts(spark, sf_dir):
    def counted(name, key):
        rows = v.table(spark, sf_dir, name)
        size = F.size(tx.sentence_split("text")).alias("n_sentences")
        return rows.select(F.lit(name).alias("role"), F.col(key).alias("id"), size)

    return counted("documents", "doc_id").unionByName(counted("benchmark", "item_id"))


@register(
    "masked_mean_pool",
    """
WITH cells AS (
  SELECT label, CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END AS m,
         unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d
  FROM embeddings)
SELECT label, CAST(d - 1 AS INTEGER) AS dim, round(sum(x * m) / greatest(sum(m), 1e-9), 6) + 0 AS mean
FROM cells GROUP BY label, d""",
)
def masked_mean_pool(spark, sf_dir):
    tokens = v.table(spark, sf_dir, "embeddings").withColumn(
        "mask", F.when(F.col("vec_id") % 3 != 0, 1).otherwise(0)
    )
    pooled = masked_mean_pool_rows(tokens, "label", "embedding", "mask")
    cells = pooled.select("label", F.posexplode("vec").alias("dim", "x"))
    return cells.select("label", "dim", (F.round("x", 6) + 0).alias("mean"))


@register(
    "encode_sentences",
    f"""
WITH pieces AS (
  SELECT item_id, CAST(i - 1 AS INTEGER) AS sent_pos, s
  FROM (SELECT item_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i
        FROM (SELECT item_id, {v.sentences_sql("text")} AS ss
              FROM (SELECT doc_id AS item_id, text FROM documents UNION ALL
                    SELECT -1 - item_id, text FROM benchmark))))
SELECT item_id, sent_pos,
       array_to_string(list_transform(vec, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ',') AS vec
FROM {v.with_vectors_sql("pieces", "s")}""",
)
def encode_query(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    items = v.table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("item_id"), "text")
    vectors = encode_sentences(tx.sentence_split("text"))
    rows = docs.unionByName(items).select(
        "item_id", F.posexplode(vectors).alias("sent_pos", "vec")
    )
    counts = F.transform("vec", lambda x: x.cast("int").cast("string"))
    return rows.select("item_id", "sent_pos", F.array_join(counts, ",").alias("vec"))
