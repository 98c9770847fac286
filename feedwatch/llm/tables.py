"""Small helpers that the operators share: column names, written tables, byte totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwatch.session import fresh_path

# What the contracts call a word: a run of characters other than space and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def fresh(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column (in any case) is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """A column by its exact name, also where the name holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder, read again: computed once, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scalar(df: DataFrame):
    """The only row of an aggregate."""
    return df.first()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)
