"""Evaluation of an encoder on anchor / positive / negative papers, over any number of triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwatch.functions import text as tx
from feedwatch.functions.vectors import EncoderFactory, encode_sentences
from feedwatch.operators import similarity as sim

ROLES = ("anchor", "positive", "negative")


def encode_papers(papers: DataFrame, encoder: EncoderFactory | None = None) -> DataFrame:
    """(triplet_id, role, title, abstract) → with title and sentence vectors."""
    title = F.array(F.coalesce("title", F.lit("")))
    sentences = tx.sentence_split(F.coalesce("abstract", F.lit("")))
    return papers.withColumns(
        {
            "title_vec": F.element_at(encode_sentences(title, encoder), 1),
            "sent_vecs": encode_sentences(sentences, encoder),
        }
    )


def triplet_rows(papers: DataFrame) -> DataFrame:
    """One row per complete triplet; ``incomplete_triplets`` lists the others."""

    def pick(role: str, name: str):
        return F.any_value(F.when(F.col("role") == role, F.col(name)), True).alias(f"{role}_{name}")

    rows = papers.groupBy("triplet_id").agg(
        *(pick(r, n) for n in ("title_vec", "sent_vecs") for r in ROLES)
    )
    return rows.dropna(subset=[f"{r}_title_vec" for r in ROLES])


def incomplete_triplets(papers: DataFrame) -> DataFrame:
    """Triplets without one of the three roles, and the roles they have."""
    known = papers.where(F.col("role").isin(*ROLES))
    found = papers.select("triplet_id").distinct().join(
        known.groupBy("triplet_id").agg(F.sort_array(F.collect_set("role")).alias("roles")), "triplet_id", "left"
    )
    roles = F.coalesce("roles", F.array().cast("array<string>"))
    return found.select("triplet_id", roles.alias("roles")).where(F.size("roles") < len(ROLES))


def triplet_eval(papers: DataFrame, num_similar: int = 4) -> DataFrame:
    """Scores and margin of every triplet of encoded papers."""
    return sim.triplet_scores(triplet_rows(papers), num_similar)
