"""Labelled rows to fit classifiers on: a bounded, seeded sample of the training fold, with texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedwatch.llm.tables import col, written

SAMPLE_ROWS = 10_000  # the bound on labelled rows a classifier is fitted on
SAMPLE_BYTES = 256 << 20  # and on their texts


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def is_held_out(doc_id: Column, parts: int, fold_no: int) -> Column:
    """Whether a row belongs to the held-out fold; a row without an id does not."""
    return F.coalesce(fold(doc_id, parts) == fold_no, F.lit(False))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    parts: int,
    fold_no: int,
    rows: int = SAMPLE_ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
    most_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """Rows (id, text, label) of at most ``rows`` labelled ids of the training fold, by a seeded hash, one for each id.

    Labels other than 0 and 1 and rows without an id are left out; an id with several labels has the
    larger, one with several texts the first of them in order.  Ids whose texts begin past ``most_bytes``, in the order of the hash, are
    left out too.  Only the bounded list of ids is broadcast.
    """
    marked = labels.where(col(doc_id).isNotNull() & col(label).isin(0, 1) & ~is_held_out(col(doc_id), parts, fold_no))
    marked = marked.groupBy(col(doc_id).alias("id")).agg(F.max(col(label)).cast("int").alias("label"))
    drawn = (F.xxhash64(F.lit("sample"), "id"), F.col("id"))
    chosen = marked.orderBy(*drawn).limit(rows)
    texts = docs.select(col(doc_id).alias("id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    sample = written(sample, "sample")
    earlier = Window.orderBy(*drawn).rowsBetween(Window.unboundedPreceding, -1)  # ``rows`` rows at most
    sized = sample.select("id", F.octet_length("text").cast("bigint").alias("size"))
    kept = sized.select("id", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before")).where(F.col("before") < most_bytes)
    return written(sample.join(F.broadcast(kept.select("id")), "id"), "sample")
