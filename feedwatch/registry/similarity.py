"""Similarity operators on stored vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedwatch.functions import text as tx
from feedwatch.operators import similarity as sim
from feedwatch.plans import similar as plan
from feedwatch.registry import register
from feedwatch.registry import views as v
from feedwatch.session import durable
from feedwatch.sources.configs import attach_targets, papers_by_id

PAIR = ["site", "target_pos", "pos"]
SET = v.VECTOR_SETTINGS
WITH = "WITH" + v.VECTORS
SCREENED = WITH + "," + v.best_sql("screened")
EVERY = WITH + "," + v.best_sql("title_pairs")


def screened(spark, sf_dir, then=lambda rows, book: rows, max_bytes=sim.MAX_TARGET_BYTES):
    """Entries with the targets whose title qualifies, and what ``then`` makes of them with the same book."""

    def run(entries, book):
        return then(sim.title_hits(entries, book, SET.title_threshold), book)

    return sim.over_books(v.papers(spark, sf_dir), v.vector_targets(spark, sf_dir), run, max_bytes)


def best(spark, sf_dir, max_bytes=sim.MAX_TARGET_BYTES):
    def then(rows, book):
        found = sim.best_sentences(rows.withColumn("n_entry_sentences", F.size("sent_vecs")), book)
        return found.drop("title_vec", "sent_vecs", "hits")

    targets = v.vector_targets(spark, sf_dir).select(
        "site", "target_pos", F.size("sent_vecs").alias("n_target_sentences")
    )
    return screened(spark, sf_dir, then, max_bytes).join(targets, ["site", "target_pos"])


def scored_pairs(spark, sf_dir, max_bytes=sim.MAX_TARGET_BYTES):
    """Entries with the scores of the targets whose title qualifies."""

    def then(rows, book):
        return sim.sentence_scores(rows, book, SET.num_similar_sentences)

    return screened(spark, sf_dir, then, max_bytes)


def rounded(name: str):
    return F.round(name, 6).alias(name)


@register(
    "title_above_threshold",
    WITH + "SELECT site, target_pos, pos, round(title_similarity, 6) AS title_similarity FROM screened",
)
def title_above_threshold(spark, sf_dir):
    rows = screened(spark, sf_dir)
    pairs = rows.select("site", "pos", F.explode("hits").alias("hit"))
    return pairs.select(*PAIR[::2], "hit.*").select(*PAIR, rounded("title_similarity"))


@register(
    "targets_x_entries",
    WITH + """
SELECT site, target_pos, count(*) AS n_pairs, count(*) FILTER (title_similarity > 0.1) AS n_title_hits
FROM title_pairs GROUP BY ALL""",
)
def targets_x_entries(spark, sf_dir):
    """Every target meets every entry of its site inside the scoring; only hits become rows."""
    rows = screened(spark, sf_dir)
    hits = rows.select("site", F.explode("hits.target_pos").alias("target_pos"))
    counted = hits.groupBy("site", "target_pos").agg(F.count("*").alias("n_title_hits"))
    targets = v.vector_targets(spark, sf_dir).select("site", "target_pos")
    compared = sim.pairs_compared(v.papers(spark, sf_dir), targets)
    return (
        targets.join(compared, "site")
        .join(counted, ["site", "target_pos"], "left")
        .select(
            "site",
            "target_pos",
            F.col("n_entries").alias("n_pairs"),
            F.coalesce("n_title_hits", F.lit(0)).alias("n_title_hits"),
        )
    )


@register(
    "title_pruning",
    WITH + """
SELECT count(*) AS n_pairs, count(*) FILTER (title_similarity > 0.1) AS n_hits, count(*) > 0 AS half_saved FROM title_pairs""",
)
def title_pruning(spark, sf_dir):
    """The threshold is applied to bounds first; the hits are those of the whole product, for half of its cosines or fewer."""
    def run(rows, book):
        found = sim.title_cosines(rows, book, SET.title_threshold)
        return sim.title_hits_or_none(found, book, SET.title_threshold)

    rows = sim.over_books(v.papers(spark, sf_dir), v.vector_targets(spark, sf_dir), run)
    compared = sim.pairs_compared(v.papers(spark, sf_dir), v.vector_targets(spark, sf_dir)).agg(F.sum("n_pairs").alias("n_pairs"))
    work = rows.agg(F.sum("n_cosines").alias("n"), F.sum(F.size("hits")).alias("n_hits"))
    return work.join(compared).select("n_pairs", "n_hits", (2 * F.col("n") <= F.col("n_pairs")).alias("half_saved"))


@register(
    "pairs_compared",
    WITH + """
SELECT site, n_entries, n_targets, n_entries * n_targets AS n_pairs
FROM (SELECT site, count(*) AS n_entries FROM papers GROUP BY site)
JOIN (SELECT site, count(*) AS n_targets FROM targets GROUP BY site) USING (site)""",
)
def pairs_compared(spark, sf_dir):
    return sim.pairs_compared(v.papers(spark, sf_dir), v.vector_targets(spark, sf_dir))


@register(
    "best_entry_sentence",
    SCREENED + "SELECT site, target_pos, pos, i, j, round(similarity, 6) AS similarity FROM best",
)
def best_entry_sentence(spark, sf_dir):
    return best(spark, sf_dir).select(*PAIR, "i", "j", rounded("similarity"))


@register(
    "sentence_pairs",
    SCREENED + """
SELECT site, target_pos, pos, any_value(n_target * n_entry) AS n_sentence_pairs,
       round(max(similarity), 6) AS best_similarity, round(min(similarity), 6) AS worst_best
FROM best GROUP BY site, target_pos, pos""",
)
def sentence_pairs(spark, sf_dir):
    """The sentence product of every surviving pair, formed as a matrix inside the scoring."""
    pairs = best(spark, sf_dir).groupBy(*PAIR).agg(
        F.any_value(F.col("n_target_sentences") * F.col("n_entry_sentences")).alias("n"),
        F.round(F.max("similarity"), 6).alias("best_similarity"),
        F.round(F.min("similarity"), 6).alias("worst_best"),
    )
    return pairs.withColumn("n_sentence_pairs", F.col("n").cast("bigint")).drop("n")


@register(
    "rank_sentence_matches",
    SCREENED + "SELECT site, target_pos, pos, i, j, rank FROM ranked",
)
def rank_sentence_matches(spark, sf_dir):
    ranked = sim.rank_sentence_matches(best(spark, sf_dir), PAIR)
    return ranked.select(*PAIR, "i", "j", F.col("rank").cast("bigint").alias("rank"))


@register("dynamic_top_k", SCREENED + "SELECT site, target_pos, pos, i, rank FROM kept")
def dynamic_top_k(spark, sf_dir):
    ranked = sim.rank_sentence_matches(best(spark, sf_dir), PAIR)
    kept = sim.dynamic_top_k(ranked, SET.num_similar_sentences)
    return kept.select(*PAIR, "i", F.col("rank").cast("bigint").alias("rank"))


@register(
    "top_k_score",
    SCREENED + "SELECT site, target_pos, pos, round(top_k_score, 6) AS top_k_score FROM scored",
)
def top_k_score(spark, sf_dir):
    ranked = sim.rank_sentence_matches(best(spark, sf_dir), PAIR)
    kept = sim.dynamic_top_k(ranked, SET.num_similar_sentences)
    return sim.top_k_score(kept, PAIR).select(*PAIR, rounded("top_k_score"))


@register(
    "top_k_score_fixed",
    SCREENED + """
SELECT site, target_pos, pos, round(sum(similarity) / 4, 6) AS top_k_score
FROM ranked WHERE rank <= 4 GROUP BY site, target_pos, pos""",
)
def top_k_score_fixed(spark, sf_dir):
    ranked = sim.rank_sentence_matches(best(spark, sf_dir), PAIR)
    return sim.top_k_score_fixed(ranked, PAIR, 4).select(*PAIR, rounded("top_k_score"))


@register(
    "sentences_above_threshold",
    SCREENED + "SELECT site, target_pos, pos, top_k_score > 0.2 AS above FROM scored",
)
def sentences_above_threshold(spark, sf_dir):
    scored = scored_pairs(spark, sf_dir)
    pairs = scored.select("site", "pos", F.explode("scored").alias("s")).select("site", "pos", "s.*")
    return pairs.select(*PAIR, sim.above("top_k_score", SET.sentence_threshold).alias("above"))


SIMILAR = """
SELECT site, target_pos, pos, round(title_similarity, 6) AS title_similarity,
       round(top_k_score, 6) AS top_k_score
FROM scored WHERE """


def _pairs(spark, sf_dir, settings, **kw):
    pairs = sim.similar_pairs(
        v.papers(spark, sf_dir), v.vector_targets(spark, sf_dir), settings, **kw
    )
    return pairs.select(*PAIR, rounded("title_similarity"), rounded("top_k_score"))


@register("is_similar_paper", EVERY + SIMILAR + "title_similarity > 0.1 AND top_k_score > 0.2")
def is_similar_paper(spark, sf_dir):
    return _pairs(spark, sf_dir, SET)


@register("is_similar_paper_or", EVERY + SIMILAR + "title_similarity > 0.1 OR top_k_score > 0.2")
def is_similar_paper_or(spark, sf_dir):
    return _pairs(spark, sf_dir, sim.Settings(4, 0.1, 0.2, use_and=False))


@register("similar_pairs_by_blocks", EVERY + SIMILAR + "title_similarity > 0.1 AND top_k_score > 0.2")
def similar_pairs_by_blocks(spark, sf_dir):
    """The way taken when targets exceed the broadcast bound (a few kB here, so there are several books)."""
    return _pairs(spark, sf_dir, SET, max_bytes=20_000)


@register(
    "pair_order",
    EVERY + """
SELECT site, target_pos, pos, row_number() OVER (PARTITION BY site, target_pos ORDER BY pos) AS place
FROM scored WHERE title_similarity > 0.1 AND top_k_score > 0.2""",
)
def pair_order(spark, sf_dir):
    """Places of qualifying entries under their target.

    Ranks come from the digest layout's bucket counts: only a bucket is ever ordered by itself.
    """
    pairs = durable(_pairs(spark, sf_dir, SET).select(*PAIR), "pairs")
    return placed(pairs, ["site", "target_pos"], "pos")


def placed(rows, keys: list[str], pos: str, width: int = 1000):
    from pyspark.sql import Window

    bucketed = rows.withColumn("bucket", F.floor(F.col(pos) / width))
    counts = bucketed.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy(*keys, "bucket").orderBy(pos)
    place = F.row_number().over(inside) + F.col("start")
    joined = bucketed.join(starts, [*keys, "bucket"])
    return joined.select(*keys, pos, place.cast("bigint").alias("place"))


# ---------------------------------------------------------------- papers and targets

CORPUS = "WITH" + v.SEARCHES
TITLES = CORPUS + "," + v.ENTRIES.strip()


@register(
    "papers_by_id",
    CORPUS + "SELECT paper_id, md5(title) AS title_md5 FROM corpus WHERE paper_id IN (SELECT paper_id FROM searches)",
)
def papers_by_id_query(spark, sf_dir):
    found = papers_by_id(v.benchmark_corpus(spark, sf_dir), v.benchmark_searches(spark, sf_dir))
    return found.select("paper_id", v.short("title").alias("title_md5"))


ATTACHED = CORPUS + """
SELECT site, search_pos, target_pos, paper_id, paper_url, md5(title) AS title_md5, md5(summary) AS summary_md5
FROM text_targets"""


def attached(spark, sf_dir):
    return attach_targets(v.benchmark_searches(spark, sf_dir), v.benchmark_corpus(spark, sf_dir))


def _attached_row(targets):
    return targets.select(
        "site",
        "search_pos",
        "target_pos",
        "paper_id",
        "paper_url",
        v.short("title").alias("title_md5"),
        v.short("summary").alias("summary_md5"),
    )


@register("paper_lookup_by_id", ATTACHED)
def paper_lookup_by_id(spark, sf_dir):
    return _attached_row(attached(spark, sf_dir))


@register(
    "attach_target_link",
    CORPUS + """
SELECT paper_id, paper_url, string_split(paper_url, '/')[-1] = paper_id AS same FROM text_targets""",
)
def attach_target_link(spark, sf_dir):
    same = tx.arxiv_id_from_link("paper_url") == F.col("paper_id")
    return attached(spark, sf_dir).select("paper_id", "paper_url", same.alias("same"))


@register(
    "title_list",
    "WITH" + v.ENTRIES + "," + v.SEARCHES + f"""
SELECT 'target' AS role, paper_id AS id, title, md5(summary) AS summary_md5, paper_url AS link FROM text_targets
UNION ALL
SELECT 'entry', id, {v.strip_sql("title")}, md5(replace(summary, chr(10), ' ')), link FROM entries""",
)
def title_list(spark, sf_dir):
    """Titles, plain summaries and links of both sides."""
    entries = plan.prepare_sentences(plan.prepare_titles(v.delivered(spark, sf_dir)))
    targets = attached(spark, sf_dir)
    columns = ["role", "id", "title", "summary_md5", "link"]
    left = targets.select(
        F.lit("target").alias("role"),
        F.col("paper_id").alias("id"),
        "title",
        v.short("summary").alias("summary_md5"),
        F.col("paper_url").alias("link"),
    )
    right = entries.select(
        F.lit("entry").alias("role"), "id", "title", v.short("summary").alias("summary_md5"), "link"
    )
    return left.unionByName(right).select(*columns)
