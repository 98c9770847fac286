"""New entries of many feeds in one stream, with the links of each feed's stored snapshot as keyed state.

The batch form (``operators.novelty``, ``plans.journal``) compares one feed's snapshot with one stored set.  Here each feed
is a key of a stateful operator: its stored links are a map in the state store, which spills to disk and is checkpointed, so a feed of any
size needs no memory for them, feeds are spread over all tasks, and nothing is read on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from feedwatch import schemas

# The state store that keeps maps on disk; a stream takes the one that is named when it starts.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
KEYS = schemas.struct(site=schemas.TEXT, snapshot=schemas.LONG, pos=schemas.LONG, link=schemas.TEXT)
_NULL = "\0"  # a missing link is a member like any other; a key of the state cannot be null


class NewSinceSnapshot(StatefulProcessor):
    """Keys (site, snapshot, pos, link) of one feed's entries to those whose link its stored snapshot lacks.

    Snapshots of a batch are taken in by their number.  One that brings a new link replaces the stored links; one that
    brings none leaves them.  So a link that left the feed is new again when it returns, if the stored links were replaced
    meanwhile.  A snapshot whose number is not above the last one taken in has been seen and gives nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        link = T.StructType([T.StructField("link", T.StringType())])
        number = T.StructType([T.StructField("snapshot", T.LongType())])
        self.stored = handle.getMapState("stored", link, number)  # link -> the snapshot it was stored with
        self.last = handle.getValueState("last", number)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        held = pd.concat(list(rows)).sort_values(["snapshot", "pos"], kind="stable")
        for number, own in held.groupby("snapshot", sort=True):
            if last is not None and number <= last:
                continue
            last = int(number)
            links = own["link"].fillna(_NULL)
            known = {x: self.stored.containsKey((x,)) for x in links.unique()}
            fresh = own[~links.map(known)]
            if len(fresh):
                for (old,) in list(self.stored.keys()):
                    if old not in known:
                        self.stored.removeKey((old,))
                for new in known:
                    self.stored.updateValue((new,), (last,))
                yield fresh
        if last is not None:
            self.last.update((last,))

    def close(self) -> None:
        pass


def new_since_snapshots(entries: DataFrame) -> DataFrame:
    """Streaming entries with a column ``snapshot`` (a growing number of a feed's snapshots) to the keys of the new ones.

    A snapshot has to come within one micro-batch.  Only keys go to the state: a task holds those of one feed's snapshots in
    a batch, and no texts.  ``entries_of`` gives the entries.
    """
    rows = entries.select("site", F.col("snapshot").cast("bigint"), F.col("pos").cast("bigint"), "link")
    return rows.groupBy("site").transformWithStateInPandas(
        statefulProcessor=NewSinceSnapshot(), outputStructType=KEYS, outputMode="Append", timeMode="None"
    )


def entries_of(keys: DataFrame, landed: DataFrame) -> DataFrame:
    """The landed entries (with ``snapshot``) that ``keys`` names."""
    named = keys.select(*(F.col(c).alias(f"_{c}") for c in ("site", "snapshot", "pos")))
    same = [landed[c].eqNullSafe(named[f"_{c}"]) for c in ("site", "snapshot", "pos")]
    return landed.join(named, same, "left_semi")


def start_new_keys_stream(landed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the keys of new entries to a table, snapshot by snapshot as they land; restarts from its checkpoint."""
    spark = landed.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        return (
            new_since_snapshots(landed).writeStream.format("parquet")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(path)
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
