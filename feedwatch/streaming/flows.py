"""Streams over landed feed files.  They reuse the batch operators unchanged."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feedwatch import schemas
from feedwatch.operators import match as mt
from feedwatch.plans.journal import run_journal
from feedwatch.sources.state import MatchState, SeenLinks


def start_match_stream(
    entries: DataFrame, watch: DataFrame, append_date: Column, state: MatchState, checkpoint: str, name: str = "stream"
) -> StreamingQuery:
    """Append the matches of newly landed entries to the weekly state, beside batch runs.

    The watchlist is the static side of the join.  Each micro-batch is a run of the state, known by the
    stream's name and the batch's number, so a batch that is retried appears once.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        rows = mt.saved_match_row(mt.matched_entries(batch, watch), append_date)
        state.append(rows, f"{name}-{batch_id}")

    return (
        entries.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def weekly_counts(saved: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Matches per Monday week, site and kind as a streaming aggregate.

    In append mode a week appears once the watermark has passed its end; the open week is pending.
    """
    week = F.window(ts, "7 days", "7 days", "4 days")
    timed = saved.withColumn(ts, F.col(ts).cast("timestamp"))
    counted = timed.withWatermark(ts, delay).groupBy(week, "site", "kind")
    return counted.agg(F.count("*").alias("n")).select(
        F.to_date("window.start").alias("week"), "site", "kind", "n"
    )


def land_snapshot(entries: DataFrame, root: str, snapshot: str) -> None:
    """Land a snapshot of any number of files; its name is added to the list once it is complete."""
    entries.write.mode("overwrite").parquet(f"{root}/data/{snapshot}")
    names = entries.sparkSession.createDataFrame([(snapshot,)], schemas.LANDED)
    names.write.mode("append").parquet(f"{root}/landed")


def start_new_entries_stream(
    spark: SparkSession, root: str, state: SeenLinks, digest_path: str, run_date: dt.date, checkpoint: str
) -> StreamingQuery:
    """Digest and new state of each landed snapshot, in the order of their names.

    The stream reads the list of complete snapshots; a micro-batch may hold several names, and each is
    read whole, however many files it has.  The state knows the snapshots it has taken in.
    """

    def snapshots(batch: DataFrame, batch_id: int) -> None:
        for row in batch.select("snapshot").distinct().orderBy("snapshot").collect():  # names only
            current = spark.read.schema(schemas.ENTRY).parquet(f"{root}/data/{row['snapshot']}")
            run_journal(current, state, digest_path, run_date, row["snapshot"])

    return (
        spark.readStream.schema(schemas.LANDED).parquet(f"{root}/landed")
        .writeStream.foreachBatch(snapshots)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_seen(entries: DataFrame, ts: str = "snapshot_ts", delay: str = "30 days") -> DataFrame:
    """Cumulative alternative: an entry passes once per link within the watermark.

    Not equal to the snapshot form, where a link that left the feed can be new again.
    """
    return entries.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["site", "link"])
