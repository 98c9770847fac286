"""Configuration files: watchlists, similarity searches, triplets and the paper lookup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedwatch import schemas
from feedwatch.functions import text as tx

YAML_ROOT = "arxiv_sites"  # fixed value: key of the rule list


def _rules(raw: DataFrame) -> DataFrame:
    """Rules numbered in file order, uniquely over all files."""
    return raw.select(
        F.monotonically_increasing_id().alias("rule_pos"),
        F.col("arxivSite").alias("site"),
        "authors",
        "words",
    )


def read_watchlist_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(schemas.WATCH_RULE).option("multiLine", True).json(path)
    return _rules(raw)


def _load_yaml(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml

    for batch in batches:
        for text in batch["value"]:
            found = yaml.safe_load(text) or {}
            rules = found.get(YAML_ROOT) or []
            yield pd.DataFrame(
                {
                    "arxivSite": [r["arxivSite"] for r in rules],
                    "authors": [r.get("authors") for r in rules],
                    "words": [r.get("words") for r in rules],
                }
            )


def read_watchlist_yaml(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return _rules(files.mapInPandas(_load_yaml, schemas.WATCH_RULE))


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """``.json`` is JSON, any other suffix is YAML."""
    return (read_watchlist_json if path.endswith(".json") else read_watchlist_yaml)(spark, path)


def read_similarity_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SIMILARITY_CONFIG).option("multiLine", True).json(path)


def similarity_settings(config: DataFrame):
    """The settings of one configuration (a single row by its format)."""
    from feedwatch.operators.similarity import Settings

    row = config.select("settings.*").first()
    return Settings(
        int(row["num_similar_sentences"]),
        float(row["title_similarity_threshold"]),
        float(row["sentence_similarity_threshold"]),
        bool(row["and_conditional"]),
    )


def similarity_searches(config: DataFrame) -> DataFrame:
    """(site, search_pos, target_pos, paper_url, paper_id).

    ``target_pos`` runs through all searches, so it stays unique when a site is searched twice.
    """
    listed = F.flatten(
        F.transform(
            "similarity_searches",
            lambda s, n: F.transform(
                s["papers"],
                lambda p: F.struct(
                    s["arxivSite"].alias("site"), n.alias("search_pos"), p.alias("paper_url")
                ),
            ),
        )
    )
    papers = config.select(F.posexplode(listed).alias("target_pos", "search"))
    return papers.select(
        "search.site",
        "search.search_pos",
        "target_pos",
        "search.paper_url",
        tx.arxiv_id_from_link("search.paper_url").alias("paper_id"),
    )


def read_triplets(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Papers of triplets: one JSON object per file, or JSON lines when ``multi_line`` is off.

    The role stands in the file or folder name; lines may carry a ``triplet_id``.
    """
    raw = spark.read.schema(schemas.PAPER_FILE).option("multiLine", multi_line).json(path)
    role = F.regexp_extract(
        F.col("_metadata.file_path"), r"(anchor|positive|negative)[^/]*(?:/part-[^/]*)?$", 1
    )
    return raw.select(
        F.coalesce("triplet_id", F.lit("0")).alias("triplet_id"),
        role.alias("role"),
        "title",
        "abstract",
    )


def papers_by_id(corpus: DataFrame, searches: DataFrame) -> DataFrame:
    """Corpus rows that some search names."""
    return corpus.join(searches.select("paper_id"), "paper_id", "left_semi")


def attach_targets(searches: DataFrame, corpus: DataFrame) -> DataFrame:
    """Searched papers with their text.  Joined by id: a paper that is missing shifts nothing."""
    return searches.join(corpus.select("paper_id", "title", "summary"), "paper_id").select(
        "site",
        "search_pos",
        "target_pos",
        "paper_id",
        "paper_url",
        "title",
        tx.newline_to_space("summary").alias("summary"),
    )
