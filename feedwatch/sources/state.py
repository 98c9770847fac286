"""State tables.  Nothing is ever rewritten in place: rows are appended, and a version or flush
becomes visible only when its marker row is, so a job that dies half way leaves no trace."""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedwatch import schemas


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


class MatchState:
    """Saved matches of the weekly flow, and the record of what has been sent.

    Rows belong to a run and an attempt, and count once the attempt is in the log of ``slices``; a run counts once,
    so a batch or stream that is repeated appends nothing.  The log names the data file of every slice (site,
    week, date): readers open the files it names for them and list no folder of data, and an append opens
    nothing but what it wrote itself, however long the history is.  A flush records the slices (site, run,
    date) that it has sent: whatever is not recorded is pending, however late it was appended.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark = spark
        self.matches_path = f"{base}/matches"
        self.slices_path = f"{base}/slices"
        self.flushes_path = f"{base}/flushes"

    def slices(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.slices_path}/*", schemas.SLICES)

    def _log_of(self, run_id: str) -> str:
        """Each run has a folder of its own in the log, found without reading the others."""
        return f"{self.slices_path}/{hashlib.sha256(run_id.encode()).hexdigest()}"

    def append(self, rows: DataFrame, run_id: str | None = None) -> bool:
        """Bag append of one run.  False if a run of this id (by default a new one) was appended before.

        Rebalancing keeps files even when one site has most of the matches.
        """
        run_id = uuid.uuid4().hex if run_id is None else run_id
        log = self._log_of(run_id)
        if not read_or_empty(self.spark, log, schemas.SLICES).isEmpty():
            return False
        attempt = uuid.uuid4().hex
        folder = f"{self.matches_path}/attempt={attempt}"
        (
            rows.select(*schemas.SAVED_MATCH.fieldNames())
            .withColumn("run_id", F.lit(run_id))
            .hint("rebalance", "week", "site")
            .write.partitionBy("week", "site")
            .parquet(folder)
        )
        # Names in the log are below the folder of matches; a path's own signs are coded once more in a file's address.
        address = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
        name = F.substring_index(F.url_decode(address), f"/attempt={attempt}/", -1)
        own = self._stored([folder]).withColumn("file", F.concat(F.lit(f"attempt={attempt}/"), name))
        held = own.groupBy("site", "week", "append_date", "file").agg(F.count("*").alias("n"))
        none = self.spark.createDataFrame([(None, None, None, None, 0)], "site string, week date, append_date date, file string, n bigint")
        marker = held.unionByName(none).withColumns({"run_id": F.lit(run_id), "attempt": F.lit(attempt)})
        marker.select(*schemas.SLICES.fieldNames()).coalesce(1).write.mode("append").parquet(log)
        return True

    def _stored(self, paths: list[str]) -> DataFrame:
        kinds = T.StructType([*schemas.SAVED_MATCH.fields, *(schemas.SLICES[n] for n in ("run_id", "attempt"))])
        if not paths:
            return self.spark.createDataFrame([], kinds)
        try:
            return self.spark.read.schema(kinds).option("basePath", self.matches_path).parquet(*paths)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], kinds).withColumn("_metadata", F.lit(None).cast("struct<file_path: string>"))

    def committed_slices(self) -> DataFrame:
        """The log of the first committed attempt of each run."""
        log = self.slices()
        attempts = log.groupBy("run_id").agg(F.min("attempt").alias("attempt"))
        return log.join(attempts, ["run_id", "attempt"], "left_semi").where("file is not null")

    def _rows_of(self, log: DataFrame) -> DataFrame:
        """Rows of the files that ``log`` names, with ``run_id``.  Names alone come to the driver, as in any file listing."""
        names = [r["file"] for r in log.select("file").distinct().collect()]
        rows = self._stored([f"{self.matches_path}/{name}" for name in sorted(names)])
        return rows.select(*schemas.SAVED_MATCH.fieldNames(), "run_id")

    def read(self, site: str | None = None, week: dt.date | None = None) -> DataFrame:
        """Saved matches; both filters prune the files that are opened."""
        log = self.committed_slices()
        filters = [] if site is None else [F.col("site") == site]
        filters += [] if week is None else [F.col("week") == F.lit(week)]
        for own in filters:
            log = log.where(own)
        rows = self._rows_of(log).drop("run_id")
        for own in filters:
            rows = rows.where(own)
        return rows

    def flushes(self) -> DataFrame:
        return read_or_empty(self.spark, self.flushes_path, schemas.FLUSHES)

    def is_flushed(self, flush_run: str) -> bool:
        return not self.flushes().where((F.col("flush_run") == flush_run) & F.col("site").isNull()).isEmpty()

    def pending_slices(self, day: dt.date, sites: DataFrame | None = None) -> DataFrame:
        """Slices (site, week, run_id, append_date, file) up to ``day`` that no flush has sent."""
        keys = ["site", "run_id", "append_date"]
        held = self.committed_slices().where(F.col("append_date") <= F.lit(day))
        if sites is not None:
            held = held.join(sites.select("site").distinct(), "site", "left_semi")
        return held.select(*keys, "week", "file").join(self.flushes().select(*keys), keys, "left_anti")

    def pending(self, day: dt.date, sites: DataFrame | None = None) -> DataFrame:
        """Rows that a flush on ``day`` has to send, for the given sites or all.  Only files of pending slices are opened."""
        due = self.pending_slices(day, sites)
        keys = ["site", "run_id", "append_date"]
        rows = self._rows_of(due)
        return rows.join(due.select(*keys).distinct(), keys, "left_semi").select(*schemas.SAVED_MATCH.fieldNames())

    def clear(self, day: dt.date, sites: DataFrame | None = None, flush_run: str | None = None) -> None:
        """Record that everything pending up to ``day`` (of the given sites) has been sent."""
        run = uuid.uuid4().hex if flush_run is None else flush_run
        stamp = {"flush_date": F.lit(day), "flush_run": F.lit(run)}
        sent = self.pending_slices(day, sites).select("site", "run_id", "append_date").distinct().withColumns(stamp)
        done = self.spark.createDataFrame([(day, run, None, None, None)], schemas.FLUSHES)
        sent = sent.select(*schemas.FLUSHES.fieldNames()).unionByName(done)
        sent.coalesce(1).write.mode("append").parquet(self.flushes_path)


class SeenLinks:
    """The key set of the last stored snapshot, as versions plus a log of committed versions."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark = spark
        self.base = base

    def log(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.base}/log", schemas.SEEN_LOG)

    def _last(self) -> tuple[int, int | None]:
        """The last committed version and the version whose links are current."""
        row = self.log().agg(F.max_by(F.struct("version", "links"), "version").alias("last")).first()["last"]
        return (0, None) if row is None else (row["version"], row["links"])

    def version(self) -> int | None:
        return self._last()[0] or None

    def has(self, snapshot: str) -> bool:
        """Whether a snapshot was taken in before, with news or without."""
        return not self.log().where(F.col("snapshot") == snapshot).isEmpty()

    def read(self) -> DataFrame:
        """Stored links; empty on the first run, when every entry is new."""
        links = self._last()[1]
        if links is None:
            return self.spark.createDataFrame([], schemas.SEEN_LINK)
        return self.spark.read.schema(schemas.SEEN_LINK).parquet(f"{self.base}/links/v{links}")

    def write(self, links: DataFrame, version: int, snapshot: str | None = None) -> None:
        """Store a whole new version, then commit it; the version being read is never touched."""
        links.select("link").write.mode("overwrite").parquet(f"{self.base}/links/v{version}")
        self._commit(version, snapshot, version)

    def keep(self, snapshot: str) -> None:
        """Commit a snapshot without news: the links stay."""
        version, links = self._last()
        self._commit(version + 1, snapshot, links)

    def _commit(self, version: int, snapshot: str | None, links: int | None) -> None:
        marker = self.spark.createDataFrame([(version, snapshot, links)], schemas.SEEN_LOG)
        marker.write.mode("append").parquet(f"{self.base}/log")


def write_digests(digests: DataFrame, path: str, run_id: str = "0") -> None:
    """Digest table by date, kind and run.

    Dynamic overwrite makes a repeated run replace what it wrote itself and nothing else: other kinds
    and other runs of the day stay.
    """
    (
        digests.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date", "kind", "run_id")
        .parquet(path)
    )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """All digests, with the run that made them."""
    kinds = T.StructType([*schemas.DIGEST.fields, T.StructField("run_id", T.StringType())])
    return read_or_empty(spark, path, kinds).select(*kinds.fieldNames())
