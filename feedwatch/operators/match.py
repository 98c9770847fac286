"""Watchlist matching: one label per entry and rule, author over title over summary.

Entries are the big side and are not shuffled: the watchlist is measured and broadcast within a
bound.  Beyond it the join is salted, so that a site with a large share of the entries is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwatch.functions import text as tx
from feedwatch.operators.joins import join_small
from feedwatch.schemas import ENTRY_FIELDS


def clean_terms(terms: Column) -> Column:
    """Missing list → empty list; missing and empty terms are dropped."""
    filled = F.coalesce(terms, F.array().cast("array<string>"))
    return F.filter(filled, lambda t: t.isNotNull() & (t != ""))


def watchlist_defaults(watch: DataFrame) -> DataFrame:
    return watch.withColumns(
        {"authors": clean_terms(F.col("authors")), "words": clean_terms(F.col("words"))}
    )


def prepare_watchlist(watch: DataFrame) -> DataFrame:
    """Defaults plus the word spellings every entry of the site will need."""
    return watchlist_defaults(watch).withColumn("forms", tx.word_forms(F.col("words")))


# ---------------------------------------------------------------- predicates


def term_occurs(text: Column, term: Column, position_zero_matches: bool = False) -> Column:
    """The term's first occurrence is past the start of the text (or anywhere, with the switch).

    "Contained but not a prefix" says the same as a position above 0, and finds it without counting
    characters.
    """
    found = F.contains(text, term)
    return found if position_zero_matches else found & ~F.startswith(text, term)


def author_match(author: Column, authors: Column, position_zero_matches: bool = False) -> Column:
    """Case-sensitive containment.  A first occurrence at the very start does not count by default."""
    hit = F.exists(authors, lambda a: term_occurs(author, a, position_zero_matches))
    return F.coalesce(hit, F.lit(False))


def word_match(text: Column, forms: Column, position_zero_matches: bool = False) -> Column:
    """Case-insensitive containment of any word, with the same rule about the start."""
    hit = tx.bind(
        F.lower(text),
        lambda t: F.exists(forms, lambda f: term_occurs(t, f["low"], position_zero_matches)),
    )
    return F.coalesce(hit, F.lit(False))


def match_label(position_zero_matches: bool = False) -> Column:
    """``author``, ``title``, ``summary`` or ``''`` for a joined (entry, rule) row."""
    flag, forms = position_zero_matches, F.col("forms")
    return (
        F.when(author_match(F.col("author"), F.col("authors"), flag), "author")
        .when(word_match(F.col("title"), forms, flag), "title")
        .when(word_match(F.col("summary"), forms, flag), "summary")
        .otherwise("")
    )


def match_kind(match: Column | str) -> Column:
    return F.when(tx.as_col(match) == "author", "author").otherwise("keyword")


# ---------------------------------------------------------------- operators


def entries_with_rules(entries: DataFrame, watch: DataFrame) -> DataFrame:
    """Every entry next to each rule of its own site (a site listed twice gives two rows)."""
    return join_small(entries, prepare_watchlist(watch), "site", salt_by="pos")


def classify_entries(
    entries: DataFrame, watch: DataFrame, position_zero_matches: bool = False
) -> DataFrame:
    """Entries of watched sites with their rule columns and the ``match`` label."""
    joined = entries_with_rules(entries, watch)
    return joined.withColumn("match", match_label(position_zero_matches))


def matched_entries(
    entries: DataFrame, watch: DataFrame, position_zero_matches: bool = False
) -> DataFrame:
    """Entries with a label.

    The label is exploded out of a filtered one-element array: a plain filter on it would be pushed
    below the projection and every text would be searched twice.
    """
    label = F.array(match_label(position_zero_matches))
    found = F.filter(label, lambda m: m != "")
    return entries_with_rules(entries, watch).withColumn("match", F.explode(found))


def term_hits(
    entries: DataFrame, watch: DataFrame, position_zero_matches: bool = False
) -> DataFrame:
    """One row per term that hits: adds ``field`` and ``term`` to the entry and rule columns.

    The terms are filtered inside the row and only hits are exploded, so the rows produced are the
    result and not entries times terms.
    """
    joined = entries_with_rules(entries, watch)

    def hit(field: str, term: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), term.alias("term"))

    def word_hits(field: str) -> Column:
        per_text = F.transform(
            F.array(F.lower(F.coalesce(F.col(field), F.lit("")))),
            lambda t: F.transform(
                F.filter(
                    F.col("forms"), lambda f: term_occurs(t, f["low"], position_zero_matches)
                ),
                lambda f: hit(field, f["low"]),
            ),
        )
        return F.flatten(per_text)

    author = F.coalesce(F.col("author"), F.lit(""))
    author_hits = F.transform(
        F.filter(F.col("authors"), lambda a: term_occurs(author, a, position_zero_matches)),
        lambda a: hit("author", a),
    )
    hits = F.concat(author_hits, word_hits("title"), word_hits("summary"))
    exploded = joined.withColumn("hit", F.explode(hits))
    return exploded.select(*joined.columns, "hit.field", "hit.term")


def any_term(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Labels from the exploded form: same precedence, decided by partial boolean aggregates."""
    seen = {f: F.bool_or(F.col("field") == f) for f in ("author", "title", "summary")}
    flags = hits.groupBy(*keys).agg(*(c.alias(f) for f, c in seen.items()))
    label = F.when(F.col("author"), "author").when(F.col("title"), "title").otherwise("summary")
    return flags.select(*keys, label.alias("match"))


def sites_without_matches(watch: DataFrame, matched: DataFrame) -> DataFrame:
    """Rules for which nothing matched."""
    return watch.join(matched.select("rule_pos").distinct(), "rule_pos", "left_anti")


def all_sites_empty(watch: DataFrame, matched: DataFrame) -> DataFrame:
    """One row: configured rules, rules without a match, and whether those are all of them."""
    found = matched.groupBy("rule_pos").agg(F.count("*").alias("n"))
    counted = watch.join(found, "rule_pos", "left")
    return counted.agg(
        F.count("*").alias("n_rules"),
        F.count_if(F.col("n").isNull()).alias("n_empty"),
    ).withColumn("all_empty", F.col("n_rules") == F.col("n_empty"))


def feed_counts(entries: DataFrame, watch: DataFrame) -> DataFrame:
    """Entries and matches per rule (map-side counts, one shuffle of a few rows)."""
    labelled = classify_entries(entries, watch)
    return labelled.groupBy("rule_pos", "site").agg(
        F.count("*").alias("n_entries"), F.count_if(F.col("match") != "").alias("n_matches")
    )


def saved_match_row(matched: DataFrame, append_date: Column) -> DataFrame:
    """The weekly state row: rule, site, label and the whole entry as a struct."""
    day = append_date.cast("date")
    return matched.select(
        "rule_pos",
        "site",
        "match",
        F.struct(*ENTRY_FIELDS).alias("entry"),
        day.alias("append_date"),
        tx.week_start(day).alias("week"),
    )
