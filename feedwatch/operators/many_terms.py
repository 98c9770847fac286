"""Watchlist matching for rules with thousands of terms: an inverted index on grams instead of a search per term.

Same labels as ``classify_entries``.  Each term is filed under the rarest of its grams (``GRAM`` neighbouring characters; a
shorter term under itself).  A text that contains a term contains that gram, so the different grams of a text, looked up
in the index, name all terms that can occur, and each of these few is verified by ``contains``.  The work for an entry grows with its text
and its candidates, not with the terms.  All of it is DataFrame expressions; the index is measured and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwatch.operators import match as mt
from feedwatch.operators.joins import text_bytes

GRAM = 4
MAX_INDEX_BYTES = 64 << 20
# Fields in the order of their labels, with the kind of terms that is looked for in each.
FIELDS = (("author", "author"), ("title", "word"), ("summary", "word"))
KEY = ["rule_pos", "site", "pos"]


def grams(text: Column, size: int) -> Column:
    """All runs of ``size`` characters, in one pass over the text."""

    def runs(chars: Column) -> Column:
        last = F.size(chars) - size
        joined = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(*(F.get(chars, i + k) for k in range(size))))
        return F.when(last >= 0, joined).otherwise(F.array().cast("array<string>"))

    return F.element_at(F.transform(F.array(F.split(text, "")), runs), 1)  # split once, however often it is used


def term_index(watch: DataFrame, size: int = GRAM) -> DataFrame:
    """(rule_pos, site, kind, term, gram) of every different term of every rule; ``gram`` is the rarest among all terms'."""
    rules = mt.prepare_watchlist(watch)
    kinds = {"author": F.col("authors"), "word": F.transform("forms", lambda f: f["low"])}
    listed = [
        rules.select("rule_pos", "site", F.lit(kind).alias("kind"), F.explode(F.array_distinct(terms)).alias("term"))
        for kind, terms in kinds.items()
    ]
    terms = listed[0].unionByName(listed[1])
    own = F.array_distinct(F.coalesce(*(F.when(F.length("term") >= n, grams(F.col("term"), n)) for n in range(size, 0, -1))))
    filed = terms.withColumn("gram", F.explode(own))
    common = filed.groupBy("kind", "gram").agg(F.count("*").alias("n"))
    ranked = filed.join(common, ["kind", "gram"])
    return ranked.groupBy("rule_pos", "site", "kind", "term").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))


def term_matches(
    entries: DataFrame, watch: DataFrame, position_zero_matches: bool = False, max_bytes: int = MAX_INDEX_BYTES
) -> DataFrame:
    """(rule_pos, site, pos, match) of entries with a label; ``site`` and ``pos`` name an entry.

    Over ``max_bytes`` of index, grams without texts are joined by a shuffle and the texts come back for the candidates.
    """
    index = term_index(watch)
    sizes = [r[0] for r in index.select(F.length("gram")).distinct().collect()]  # ``GRAM`` numbers at most
    if not sizes:
        return entries.where("false").select(F.lit(0).cast("bigint").alias("rule_pos"), "site", "pos", F.lit("").alias("match"))
    texts = F.array(
        *(
            F.struct(
                F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
                (F.lower(field) if kind == "word" else F.col(field)).alias("text"),
            )
            for rank, (field, kind) in enumerate(FIELDS)
        )
    )
    fields = entries.select("site", "pos", F.explode(texts).alias("x")).select("site", "pos", "x.*").where("text is not null")
    own = F.array_distinct(F.flatten(F.array(*(grams(F.col("text"), n) for n in sorted(sizes)))))
    if text_bytes(index) <= max_bytes:
        spread = fields.withColumn("gram", F.explode(own))
        found = spread.join(F.broadcast(index), ["site", "kind", "gram"])
    else:
        light = fields.select("site", "pos", "rank", "kind", F.explode(own).alias("gram"))
        named = light.join(index, ["site", "kind", "gram"]).select("site", "pos", "rank", "rule_pos", "term")
        found = named.join(fields.drop("kind"), ["site", "pos", "rank"])
    hits = found.where(mt.term_occurs(F.col("text"), F.col("term"), position_zero_matches))
    first = hits.groupBy(*KEY).agg(F.min("rank").alias("rank"))
    labels = F.array(*(F.lit(name) for name, _ in FIELDS))
    return first.select(*KEY, F.get(labels, F.col("rank")).alias("match"))


def classify_many_terms(
    entries: DataFrame, watch: DataFrame, position_zero_matches: bool = False, max_bytes: int = MAX_INDEX_BYTES
) -> DataFrame:
    """(rule_pos, site, pos, match) of every entry and rule of its site, as ``classify_entries`` labels them."""
    found = term_matches(entries, watch, position_zero_matches, max_bytes)
    pairs = entries.select("site", "pos").join(watch.select("rule_pos", "site"), "site")
    return pairs.join(found, KEY, "left").select(*KEY, F.coalesce("match", F.lit("")).alias("match"))
