"""Landed feed files: RSS and Atom as delivered.  Batch and streaming.

Spark lists the files (its file source, or its file stream, which reads each newly landed file once) and each file is
parsed once, by one pass that emits RSS items and Atom entries together with their places.  The pass gets a file in pieces
that follow one another, so a Python worker never holds a whole file.  A position is made of the
file and the place in it, so it is the same in batch and stream and however files are packed into tasks.

A feed may come in any number of files, so that no file has to hold a whole hot site.  Files in ``page=<number>``
folders follow each other by that number; others are ordered by a 41-bit hash of their path.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import partial
from urllib.parse import unquote
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedwatch import schemas

ITEM_BITS = 21  # of a position number the items of a file
BATCH_ITEMS = 512
PIECE_BYTES = 1 << 16  # an Arrow batch holds up to 512 pieces
BATCH_BYTES = 1 << 20  # of a file, whose items are sent on together
_FILES = schemas.struct(path=schemas.TEXT, modificationTime=schemas.TIME, length=schemas.LONG, content=schemas.BYTES)
_ROWS = [*schemas.ENTRY.fieldNames(), "error"]
_KINDS = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in schemas.ENTRY.fields), "error string"])
_ARROW = pa.schema([(n, pa.int64() if n == "pos" else pa.string()) for n in _ROWS])


class FeedParser:
    """Items of one feed file, as dictionaries of an entry's fields, in file order.

    Names of elements are taken without their prefix.  Text of elements within an element belongs to it; named entities that a
    feed does not declare are those of HTML.
    """

    def __init__(self) -> None:
        self.items: list[dict] = []
        self.own: dict | None = None  # children of the open item, by name
        self.path: list[str] = []  # open elements within the item
        self.parser = expat.ParserCreate()
        self.parser.buffer_text = True
        self.parser.UseForeignDTD(True)  # or an undeclared entity is an error
        self.parser.StartElementHandler = self._start
        self.parser.EndElementHandler = self._end
        self.parser.CharacterDataHandler = self._text
        self.parser.SkippedEntityHandler = lambda name, _: self._text(html.unescape(f"&{name};"))

    def feed(self, data: bytes, last: bool) -> list[dict]:
        """Items that ``data`` completes."""
        self.parser.Parse(data, last)
        done, self.items = self.items, []
        return done

    def _start(self, tag: str, attributes: dict) -> None:
        name = tag.rpartition(":")[2]
        if self.own is None:
            if name in ("item", "entry"):
                self.own = {}
            return
        self.path.append(name)
        if len(self.path) == 1:
            self.own.setdefault(name, []).append({"text": "", **{k.rpartition(":")[2]: v for k, v in attributes.items()}})
        elif self.path == ["author", "name"]:
            self.own["author"][-1]["name"] = ""

    def _text(self, data: str) -> None:
        if self.own is not None and self.path:
            self.own[self.path[0]][-1]["text"] += data
            if self.path == ["author", "name"]:
                self.own["author"][-1]["name"] += data

    def _end(self, tag: str) -> None:
        if self.own is None:
            return
        if self.path:
            self.path.pop()
            return
        self.items.append(entry_fields(self.own))
        self.own = None


def entry_fields(own: dict[str, list[dict]]) -> dict:
    """An entry's fields, each from the first element that has it."""

    def first(*names: str) -> str | None:
        return next((own[n][0]["text"] for n in names if n in own), None)

    links = own.get("link", [])
    link = next((x for x in links if x.get("rel", "alternate") == "alternate"), links[0] if links else None)
    link = None if link is None else link["text"] if link["text"] or "href" not in link else link["href"]
    guid = first("guid")
    makers = [x["text"] for x in own.get("creator", [])] or [x.get("name", x["text"]) for x in own.get("author", [])]
    address = link if link is not None else guid if guid is not None and re.match("https?://", guid) else None
    number = first("pos")
    return {
        "site": first("site"),
        "pos": int(number) if number is not None else None,
        "id": next((x for x in (first("id"), guid, link) if x is not None), None),
        "title": first("title"),
        "author": ", ".join(makers) if makers else None,
        "summary": first("summary", "description", "content", "encoded"),
        "link": address,
        "published": first("published", "pubDate", "date", "updated"),
    }


def site_of(path: str) -> str:
    """Site of a landed file: its ``site=…`` folder, or the name of a file ``<site>.xml``."""
    folder = re.search(r"/site=([^/]+)/", path)
    return unquote(folder[1]) if folder else re.sub(r"\.xml$", "", path.rpartition("/")[2])


def first_position(path: str) -> int:
    """Position of a file's first item: by its page number, or after all pages by the hash of its path."""
    page = re.search(r"/page=(\d+)/", path)
    if page:
        return int(page[1]) << ITEM_BITS
    digest = hashlib.blake2b(path.encode(), digest_size=8).digest()
    return 1 << 62 | int.from_bytes(digest) >> 23 << ITEM_BITS


def _parse(batches: Iterator[pa.RecordBatch], number: bool = True) -> Iterator[pa.RecordBatch]:
    """Pieces of files (path, piece, data, last) to entries; a file that breaks off gives what came before and a row with the error."""
    parser, rows, size = None, [], 0
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in (0, 1, 3)]
        for (path, piece, last), data in zip(zip(*columns, strict=True), batch.column(2), strict=True):
            if piece == 0:
                parser, site, begin, place = FeedParser(), site_of(path), first_position(path), 0
            if parser is None:  # the file broke off before
                continue
            error, data = None, data.as_py()
            try:
                found = parser.feed(data, last)
            except (expat.ExpatError, ValueError) as broken:
                found, error = parser.items, f"{path}: {broken}"
            for own in found:
                if place >> ITEM_BITS:
                    raise ValueError(f"{path} holds too many items for one file: land it as several")
                own["site"] = own["site"] or site
                own["pos"] = begin + place if own["pos"] is None and number else own["pos"]
                rows.append({**own, "error": None})
                place += 1
            if error is not None:
                rows.append({**dict.fromkeys(_ROWS), "error": error})
                parser = None
            size += len(data)
            while len(rows) >= BATCH_ITEMS or rows and size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows[:BATCH_ITEMS], _ARROW)
                del rows[:BATCH_ITEMS]
                size = 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def _pieces(files: DataFrame) -> DataFrame:
    """(path, piece, data, last) of every file; the pieces of a file follow one another within a task."""
    pieces = F.greatest(F.ceil(F.length("content") / PIECE_BYTES), F.lit(1)).cast("int")
    cut = files.select("path", "content", pieces.alias("pieces")).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    data = F.substring("content", F.col("piece") * PIECE_BYTES + 1, F.lit(PIECE_BYTES))
    return cut.select("path", "piece", data.alias("data"), (F.col("piece") == F.col("pieces") - 1).alias("last"))


def _parsed(files: DataFrame, number: bool = True) -> DataFrame:
    return _pieces(files).mapInArrow(partial(_parse, number=number), _KINDS)


def _entries(files: DataFrame, site: Column | None, strict: bool, landed_pos: bool = False) -> DataFrame:
    parsed = _parsed(files, number=not landed_pos)
    broken = F.raise_error(F.col("error")).cast("boolean") if strict else F.lit(False)
    own = parsed.where(F.when(F.col("error").isNotNull(), broken).otherwise(F.lit(True)))
    return (own if site is None else own.withColumn("site", site)).select(*schemas.ENTRY.fieldNames())


def _reader(source):
    return source.schema(_FILES).format("binaryFile").option("recursiveFileLookup", "true")


def read_feed(
    spark: SparkSession, path: str, site: Column | None = None, landed_pos: bool = False, strict: bool = True
) -> DataFrame:
    """Entries of landed RSS and Atom files.

    Items that the landing job numbered (an element ``pos``) keep their positions; with ``landed_pos`` no others are made.  A file
    that is no well-formed XML fails the job, or is read as far as it goes if not ``strict``; see ``feed_rejects``.  Files of no bytes are no
    feeds: Spark does not open them.
    """
    return _entries(_reader(spark.read).load(path), site, strict, landed_pos)


def feed_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(error) of every landed file that is not well-formed; the error begins with the file's path."""
    return _parsed(_reader(spark.read).load(path)).where("error is not null").select("error")


def read_site_feed(spark: SparkSession, root: str, **kw) -> DataFrame:
    return read_feed(spark, f"{root}/feed_kind=site", **kw)


def read_new_feed(spark: SparkSession, root: str, **kw) -> DataFrame:
    return read_feed(spark, f"{root}/feed_kind=new", **kw)


def read_journal_feed(spark: SparkSession, path: str, site: str = "journal", **kw) -> DataFrame:
    """One fixed feed: the site is a constant."""
    return read_feed(spark, path, site=F.lit(site), **kw)


def stream_feed(
    spark: SparkSession, path: str, site: Column | None = None, max_files: int | None = None, strict: bool = True
) -> DataFrame:
    """The same files as a stream, with the same positions: each newly landed file is read once."""
    reader = _reader(spark.readStream)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _entries(reader.load(path), site, strict)


def land_feed(entries: DataFrame, path: str) -> None:
    """Write entries as feed files, one folder per site (used to convert and in round trips).

    The rebalance hint splits a site that holds many entries over several files and keeps small
    sites in one.
    """
    spread = entries.hint("rebalance", "site")
    (
        spread.write.format("xml")
        .option("rootTag", "rss")
        .option("rowTag", "item")
        .partitionBy("site")
        .save(path)
    )
