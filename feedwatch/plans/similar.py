"""Similarity flow: feed entries close to chosen target papers, and their digest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwatch.functions import formats as fmt
from feedwatch.functions import text as tx
from feedwatch.functions.html import html_to_text
from feedwatch.functions.vectors import EncoderFactory, encode_sentences, hashed_encoder
from feedwatch.operators import similarity as sim
from feedwatch.operators.joins import join_small
from feedwatch.operators.digest import PER_PART, digest_concat
from feedwatch.plans.daily import digest_table
from feedwatch.session import durable


def encode_targets(targets: DataFrame, encoder: EncoderFactory | None = None) -> DataFrame:
    """Target papers with title and sentence vectors, computed once and stored."""
    title = F.array(F.coalesce("title", F.lit("")))
    encoded = targets.withColumns(
        {
            "title_vec": F.element_at(encode_sentences(title, encoder), 1),
            "sent_vecs": encode_sentences(
                tx.sentence_split(F.coalesce("summary", F.lit(""))), encoder
            ),
        }
    )
    return durable(encoded, "targets")


def prepare_titles(entries: DataFrame) -> DataFrame:
    return entries.withColumn("title", tx.arxiv_title_clean(F.coalesce("title", F.lit(""))))


def prepare_sentences(entries: DataFrame) -> DataFrame:
    """Plain text and sentences of the summary."""
    plain = entries.withColumn("summary", html_to_text(F.coalesce("summary", F.lit(""))))
    return plain.withColumn("sentences", tx.sentence_split("summary"))


def similar_papers(
    entries: DataFrame,
    targets: DataFrame,
    settings: sim.Settings,
    encoder: EncoderFactory | None = None,
    prune: bool = True,
    max_target_bytes: int = sim.MAX_TARGET_BYTES,
    spread: int | None = None,
) -> DataFrame:
    """Qualifying pairs of feed entries and encoded targets, with the entry's own columns.

    One pass over the entries without a shuffle: titles are encoded and screened first, and under
    AND only the survivors' summaries are parsed, split, encoded and scored.  Survivors cluster
    (copies are landed together), so ``spread`` can deal them out evenly before the costly part.
    """
    pairs = sim.similar_pairs(
        prepare_titles(entries),
        targets,
        settings,
        encoder or hashed_encoder(),
        title="title",
        sentences="sentences",
        prune=prune,
        max_bytes=max_target_bytes,
        prepare=prepare_sentences,
        spread=spread,
    )
    columns = [c for c in entries.columns if c in pairs.columns]
    return pairs.select(*columns, "target_pos", "title_similarity", "top_k_score")


def sentence_report(
    entries: DataFrame, targets: DataFrame, settings: sim.Settings, most: int, encoder: EncoderFactory | None = None,
    max_target_bytes: int = sim.MAX_TARGET_BYTES,
) -> DataFrame:
    """The best ``most`` sentence pairs of each pair whose titles are close, with both sentences.

    Ranking happens within the entry's row, so only the reported rows leave the map.  Ranks are within
    one pair, so targets over the broadcast bound are reported on book by book.
    """
    encoder = encoder or hashed_encoder()

    def report(titled: DataFrame, book) -> DataFrame:
        near = sim.title_hits(titled, book, settings.title_threshold, "title", encoder)
        best = sim.best_sentences(prepare_sentences(near), book, "sentences", encoder, most)
        return best.select(
            "site", "target_pos", "pos", "rank", "i", "j", "similarity", F.get("sentences", F.col("j")).alias("entry_sentence")
        )

    rows = sim.over_books(prepare_titles(entries), targets, report, max_target_bytes)
    texts = targets.select("site", "target_pos", tx.sentence_split("summary").alias("_known"))
    joined = join_small(rows, texts, ["site", "target_pos"], "pos")
    return joined.withColumn("target_sentence", F.get("_known", F.col("i"))).drop("_known")


def pair_attributes(pairs: DataFrame, targets: DataFrame) -> DataFrame:
    """Both sides' title, summary and link.  Only qualifying pairs reach this join."""
    known = targets.select(
        "site",
        "target_pos",
        "search_pos",
        F.col("title").alias("target_title"),
        F.col("summary").alias("target_summary"),
        F.col("paper_url").alias("target_link"),
    )
    return join_small(pairs, known, ["site", "target_pos"], salt_by="pos")


def render_pairs(pairs: DataFrame, keep: list[str]) -> DataFrame:
    return pairs.select(
        *keep,
        tx.render_pair_html(
            "title", "summary", "id", "target_title", "target_summary", "target_link"
        ).alias("html"),
        tx.render_pair_text("title", "summary", "target_title", "target_summary").alias("plain"),
    )


def similarity_digest(
    pairs: DataFrame, targets: DataFrame, run_date: dt.date, per_part: int = PER_PART
) -> DataFrame:
    """Digest per search, pairs by target and then entry; no row without a pair."""
    searched = targets.select("site", "target_pos", "search_pos")
    pairs = durable(join_small(pairs, searched, ["site", "target_pos"], "pos"), "pairs")
    keys, order = ["search_pos", "site"], ["target_pos", "pos"]
    name = F.concat(F.lit("Similarity Results for "), F.col("site"))
    parts = digest_concat(
        pairs,
        keys,
        order,
        lambda placed, keep: render_pairs(
            pair_attributes(placed.drop("search_pos"), targets), keep
        ),
        F.concat(F.lit(fmt.SIMILARITY_HEADER), F.lit("<h1> "), name, F.lit("</h1>")),
        F.lit(fmt.SIMILARITY_FOOTER),
        F.concat(name, F.lit("\n")),
        per_part,
    )
    named = parts.withColumns(
        {
            "config_pos": F.col("search_pos").cast("bigint"),
            "kind": F.lit("similarity"),
            "subject": tx.similarity_subject("site"),
        }
    )
    return digest_table(named, run_date)
