"""What is new in a feed compared with a stored key set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def new_entries(current: DataFrame, seen: DataFrame, key: str = "link") -> DataFrame:
    """Entries whose key is not stored; duplicates inside the snapshot stay.

    Null-safe, because a missing key is a member like any other.  The stored side is distinct, so a
    hot key can only sit on the streamed side, where adaptive execution splits it.
    """
    stored = seen.select(F.col(key).alias("_stored"))
    return current.join(stored, current[key].eqNullSafe(stored["_stored"]), "left_anti")


def distinct_links(entries: DataFrame, key: str = "link") -> DataFrame:
    """The key set of a snapshot (map-side de-duplication before the shuffle)."""
    return entries.select(key).distinct()


def link_difference(current: DataFrame, seen: DataFrame, key: str = "link") -> DataFrame:
    """Bag difference by key; unlike ``exceptAll`` it never removes single copies."""
    return new_entries(current, seen, key)


def next_state(current: DataFrame, seen: DataFrame, key: str = "link") -> DataFrame:
    """Stored set after a snapshot: replaced when anything is new, else unchanged."""
    fresh = new_entries(current, seen, key).agg(F.count("*").alias("n"))
    changed = fresh.select(F.col("n") > 0).scalar()
    kept = seen.select(key).where(~changed)
    return distinct_links(current, key).where(changed).unionByName(kept)
