"""Mixing sources to target weights: capped water-filling and seeded repetitions of documents.

A source's target is its weight's share of the budget, but no more than ``max_epochs`` times its own
size; what a clamped source cannot take is shared among the others by weight until no target is above
its bound.  A document is repeated ``floor(target / source_size)`` times, and once more if it comes early
enough in the source's seeded order: documents join in that order while the middle of the document
lies before the rest of the target, so the words taken differ from the target by at most half of one
document's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedwatch.llm.tables import WORD, col, fresh, scalar, written

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def _numbered(sources: DataFrame) -> DataFrame:
    """Rows with ``no``, the place of ``source`` by code point from 0, nulls last.

    Ranges are numbered apart and shifted by the counts before them, so no task sees all sources.
    """
    ranged = sources.repartitionByRange(F.col("source").asc_nulls_last())
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range; a cluster has as many as shuffle partitions.
    shifts = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranged.join(shifts, "part").withColumn("no", F.col("shift") + within - 1).drop("part", "shift")


def water_fill(sources: DataFrame, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Rows (source, source_size, weight) with ``target``.

    Each round clamps the sources whose share is above their bound and shares what is left of the
    budget among the others by weight; a source once clamped stays so.  Two sums a round reach the
    driver.  Sources without words or weight get nothing; a budget beyond all bounds fills them all.
    """
    bound = F.col("source_size") * F.lit(float(max_epochs))
    total = scalar(sources.agg(F.sum("source_size")))[0] or 0
    words = budget * total
    level, n_clamped = 0.0, -1  # what a weight of one gets
    while True:
        clamped = F.col("weight") * F.lit(level) >= bound
        row = scalar(
            sources.agg(
                F.sum(F.when(clamped, bound).otherwise(0.0)).alias("given"),
                F.sum(F.when(clamped, 0.0).otherwise(F.col("weight").cast("double"))).alias("weight"),
                F.count(F.when(clamped, True)).alias("n"),
            )
        )
        if not row["weight"] or row["n"] == n_clamped:
            break
        n_clamped = row["n"]
        level = max((words - row["given"]) / row["weight"], level)
    return sources.withColumn("target", F.least(bound, F.col("weight") * F.lit(level)))


def _repeats(sized: DataFrame, seed: int) -> DataFrame:
    """Rows (row, id, source, size, source_size, target) with ``repeats``.

    The order within a source is by a seeded hash of the id, then by row.  Sums of 4,096 ranges of
    the hash come first, and a running sum over them; only the range in which a source's fractional
    epoch ends is put in order, so a source with a third of all documents is never in one task.
    """
    keyed = sized.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    keyed = keyed.withColumn("range", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keyed = keyed.withColumn("whole", F.floor(rate)).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("end", F.sum("words").over(running)).withColumn("begin", F.col("end") - F.col("words"))
    ends = F.when(F.col("end") <= F.col("rest"), 1).when(F.col("begin") >= F.col("rest"), -1).otherwise(0)
    state = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), "begin", ends.alias("state"))
    # At most 4,096 rows a source; the join splits by source and range.
    placed = keyed.join(state, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))).drop("s", "r")
    whole = placed.where("state <> 0").withColumn("more", (F.col("state") > 0).cast("int"))
    order = Window.partitionBy("source", "range").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("begin") + F.sum("size").over(order) - F.col("size") / 2
    split = placed.where("state = 0").withColumn("more", (middle <= F.col("rest")).cast("int"))
    both = whole.unionByName(split)
    return both.withColumn("repeats", (F.col("whole") + F.col("more")).cast("bigint"))


def mix_plan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    row: str | None = None,
) -> DataFrame:
    """(row, id, source, size, source_size, target, repeats) for every row of ``docs``.

    Sources in code-point order (null last, as a source of its own) get ``weights`` in turn.  A null
    text has size 0 and is taken with the others of its range; a source without words has target 0.
    Rows with the same id share their place in the order and are told apart by ``row``.
    """
    ident = F.monotonically_increasing_id() if row is None else col(row)
    sized = docs.select(
        ident.alias("row"), col(doc_id).alias("id"), col(source).alias("source"), n_words(col(text)).alias("size")
    )
    sized = written(sized, "sized")
    sources = _numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = written(
        sources.withColumn("weight", F.get(turn, F.pmod("no", F.lit(len(weights))).cast("int"))), "weights"
    )
    filled = water_fill(sources, budget, max_epochs).select(F.col("source").alias("s"), "source_size", "target")
    joined = sized.join(filled, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    return _repeats(joined, seed).select("row", "id", "source", "size", "source_size", "target", "repeats")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **params) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns."""
    row, times = fresh("fw_row", docs.columns), fresh("fw_times", docs.columns)
    held = written(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    plan = mix_plan(held, doc_id, text, source, row=row, **params).where("repeats > 0")
    plan = plan.select(F.col("row").alias(row), F.col("repeats").alias(times))
    taken = held.join(plan, row)
    copies = F.explode(F.array_repeat(F.lit(0), F.col(times).cast("int")))
    return taken.withColumn(fresh("fw_copy", taken.columns), copies).select(*map(col, docs.columns))
