"""Ordered concatenation of rendered entries into digests that stay bounded at any scale.

A digest is the header, the entries in order and the footer.  A site may hold a third of all
entries, so a digest is cut into parts: joined in part order the parts are exactly the one message,
and a digest of up to ``per_part`` entries and ``part_bytes`` of text is one part.

Where an entry falls depends on how many entries and bytes come before it, a running sum over the
whole site.  It is taken in two levels: entries are stored once in ranges of their order, each range
sums up for itself, and only one row a range and site is summed over the site.  What is planned that
way are intervals of stored rows, a few for each part, however positions are spaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedwatch.operators.joins import join_small
from feedwatch.session import durable

PER_PART = 1000
PART_BYTES = 64 << 20  # of an entry's strings, before rendering
ROW, SIZE, RANGE, BUCKET = "_row", "_size", "_range", "_bucket"

# (entries, columns to keep) -> those columns with ``html`` and ``plain``
Render = Callable[[DataFrame, list[str]], DataFrame]


def in_ranges(items: DataFrame, keys: list[str], order: list[str], per_part: int) -> DataFrame:
    """Items stored in ranges of (keys, order), with their running row number and their size.

    A bucket of ``per_part`` positions is never split over two ranges.  The number holds the range in its upper bits and
    counts without gaps within one.
    """
    *lead, pos = order
    texts = [f.name for f in items.schema.fields if isinstance(f.dataType, T.StringType)]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c in texts), F.lit(0).cast("bigint"))
    bucketed = items.withColumn(BUCKET, F.expr(f"`{pos}` div {per_part}"))
    ranged = bucketed.repartitionByRange(*keys, *lead, BUCKET).sortWithinPartitions(*keys, *lead, pos)
    return durable(ranged.withColumns({ROW: F.monotonically_increasing_id(), SIZE: size}), "ranges")


def _join_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join in which a null key meets a null key."""
    other = right.withColumnsRenamed({c: f"{c}_r" for c in on})
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in on))
    return left.join(other, same).drop(*(f"{c}_r" for c in on))


def digest_layout(
    ranged: DataFrame, keys: list[str], order: list[str], per_part: int = PER_PART, part_bytes: int = PART_BYTES
) -> DataFrame:
    """Intervals of stored rows (lo to hi) with their part, and the number of parts and entries of each digest.

    A bucket goes to the part in which the entries before it, counted by ``per_part``, end; within that
    a new part begins with every ``part_bytes``.
    """
    lead = order[:-1]
    own = [*keys, RANGE]
    light = ranged.select(*keys, *lead, BUCKET, ROW, SIZE, F.shiftrightunsigned(ROW, 33).alias(RANGE))
    # Of the whole site: one row a range.
    sums = light.groupBy(*own).agg(F.count("*").alias("n"), F.sum(SIZE).alias("size"), F.min(ROW).alias("first"))
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *own, "first", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "size"))
    )
    # Within a range: buckets begin at their first row, bytes are summed row by row.
    opened = F.min(ROW).over(Window.partitionBy(*own, *lead, BUCKET))
    above = Window.partitionBy(*own).orderBy(ROW).rowsBetween(Window.unboundedPreceding, -1)
    rows = light.select(*own, ROW, opened.alias("opened"), F.coalesce(F.sum(SIZE).over(above), F.lit(0)).alias("above"))
    slots = _join_safe(rows, starts, own).select(
        *own,
        ROW,
        F.expr(f"(n_before + opened - first) div {per_part}").alias("slot"),
        F.expr(f"(size_before + above) div {part_bytes}").alias("weight"),
    )
    pieces = slots.groupBy(*own, "slot", "weight").agg(
        F.min(ROW).alias("lo"), F.max(ROW).alias("hi"), F.count("*").alias("n")
    )
    pieces = durable(pieces, "pieces")
    # Parts are numbered the same way: within a range, and over the ranges, which may share a part at their edge.
    edge = F.struct("slot", "weight")
    held = pieces.groupBy(*own).agg(
        F.min(edge).alias("first"), F.max(edge).alias("last"), F.count("*").alias("m"), F.sum("n").alias("n")
    )
    in_turn = Window.partitionBy(*keys).orderBy(RANGE)
    held = held.withColumn("shared", F.col("first").eqNullSafe(F.lag("last").over(in_turn)).cast("bigint"))
    held = held.withColumn("new", F.col("m") - F.col("shared"))
    whole = Window.partitionBy(*keys)
    numbered = held.select(
        *own,
        (F.coalesce(F.sum("new").over(earlier), F.lit(0)) - F.col("shared")).alias("before"),
        F.sum("new").over(whole).alias("n_parts"),
        F.sum("n").over(whole).alias("n_entries"),
    )
    within = F.row_number().over(Window.partitionBy(*own).orderBy("slot", "weight")) - 1
    placed = _join_safe(pieces.withColumn("within", within), numbered, own)
    return placed.select("lo", "hi", (F.col("before") + F.col("within")).alias("part"), "n_parts", "n_entries")


def place_in_parts(ranged: DataFrame, layout: DataFrame, per_part: int) -> DataFrame:
    """Stored items with the part whose interval holds them; intervals are found by cells of ``per_part`` rows."""
    cells = F.sequence(F.expr(f"lo div {per_part}"), F.expr(f"hi div {per_part}"))
    celled = layout.withColumn("_cell", F.explode(cells))
    found = join_small(ranged.withColumn("_cell", F.expr(f"{ROW} div {per_part}")), celled, "_cell", salt_by=ROW)
    return found.where(F.col(ROW).between(F.col("lo"), F.col("hi"))).drop("_cell", "lo", "hi", ROW, SIZE, BUCKET)


def digest_concat(
    items: DataFrame,
    keys: list[str],
    order: list[str],
    render: Render,
    header: Column,
    footer: Column,
    plain_header: Column | None = None,
    per_part: int = PER_PART,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Entries (keys, order columns and whatever ``render`` needs) → one row per digest part.

    ``order`` ends with a non-negative position that is unique under the columns before it;
    ``header``, ``footer`` and ``plain_header`` may use the keys.  Entries travel to their part as
    they are and are rendered there: both rendered forms together are over twice as large.  A part has fewer
    than twice ``per_part`` entries, and at most one entry more than ``part_bytes`` hold.
    """
    # Entries without a position would be in no definite place.
    missing = F.raise_error(F.lit("an entry has no position: assign positions when landing"))
    items = items.withColumn(order[-1], F.coalesce(F.col(order[-1]), missing.cast("bigint")))
    ranged = in_ranges(items, keys, order, per_part)
    layout = durable(digest_layout(ranged, keys, order, per_part, part_bytes), "layout")
    placed = place_in_parts(ranged, layout, per_part)
    groups = [*keys, "part", "n_parts", "n_entries"]
    rendered = render(placed.repartition(*keys, "part"), [*groups, *order])
    sequence = ", ".join(order)
    parts = rendered.groupBy(*groups).agg(
        F.expr(f"listagg(html, '') WITHIN GROUP (ORDER BY {sequence})").alias("html"),
        F.expr(f"listagg(plain, '') WITHIN GROUP (ORDER BY {sequence})").alias("plain"),
    )
    first, last = F.col("part") == 0, F.col("part") == F.col("n_parts") - 1
    empty = F.lit("")
    return parts.withColumns(
        {
            "html": F.concat(
                F.when(first, header).otherwise(empty),
                F.col("html"),
                F.when(last, footer).otherwise(empty),
            ),
            "plain": F.concat(
                F.when(first, empty if plain_header is None else plain_header).otherwise(empty),
                F.col("plain"),
            ),
        }
    )
