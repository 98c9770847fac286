"""Joins with a side that is meant to be small: measured first, broadcast only within a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
SALTS = 32


def text_bytes(df: DataFrame) -> int:
    """Size of the rows as text, by one aggregate over the (configuration-sized) side."""
    size = F.octet_length(F.to_json(F.struct("*"))).cast("bigint")
    return df.agg(F.sum(size)).first()[0] or 0


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: str | list[str],
    salt_by: str,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Inner join that leaves ``big`` where it is as long as ``small`` is within ``max_bytes``.

    Spark's own estimate is not relied on: rows made in Python or by a Python reader have none, and
    the feed would be shuffled for a watchlist of a few rows.  A larger side is joined by a shuffle
    on the key and a salt, so that a site with a third of all entries is spread over many tasks.
    """
    keys = [on] if isinstance(on, str) else on
    if text_bytes(small) <= max_bytes:
        return big.join(F.broadcast(small), keys)
    salt = F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    spread = big.withColumn("_salt", salt).join(small.withColumn("_salt", copies), [*keys, "_salt"])
    return spread.drop("_salt")
