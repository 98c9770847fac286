"""Token ids of documents in raw binary shards, with a minimal perfect hash from keys to offsets.

Format, all numbers little-endian: ``shards/`` holds files of nothing but ids (16 bits each while the
vocabulary allows it, else 32), documents in ascending id order (null last), each ended by the end
id.  ``index/`` holds segments: a perfect hash of the segment's keys, then one record for each key at
its number (a 32-bit fingerprint of the key, shard number, first id's place in the shard, number of
ids), then the keys whose hash is not theirs alone, with their second hash.  ``rows`` and ``segments`` are Parquet tables that name the files.  A key is found in
constant time: its hash names the segment, the perfect hash the record, the fingerprint tells whether
the key is stored at all, and the record which bytes of which shard to read.

A key is (doc_id, copy): rows with the same id are copies 0, 1, ... in file order.  A null text is an
empty document and holds the end id only.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedwatch.llm.files import get, put
from feedwatch.llm.perfect_hash import PerfectHash
from feedwatch.llm.tables import col, scalar, written
from feedwatch.llm.words import slices
from feedwatch.llm.wordwise import ragged, split_parts
from feedwatch.session import fresh_path

END_ID = 2
TASK_BYTES = 64 << 20  # of text in one task
SHARD_BYTES = 16 << 20  # a shard ends with the document that reaches this
SEGMENT_KEYS = 1 << 18
CACHE_WORDS = 450_000  # words in each of the two generations that a Python worker remembers
JOINED = 200  # new words that the library gets as one text
SLICE_BYTES = 8 << 20
RECORD = np.dtype([("print", "<u4"), ("shard", "<i4"), ("place", "<i8"), ("n", "<i8")])
TWIN = np.dtype([("h", "<u8"), ("p", "<u8"), ("shard", "<i4"), ("place", "<i8"), ("n", "<i8")])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


class WordwiseEncoder:
    """Byte-level BPE of whole texts by the ``tokenizers`` library, each different word once.

    The byte-level splitting rule always begins a new piece at a blank that is followed by something
    else, so a text's ids are those of its parts cut before such blanks (``wordwise``).  Parts seen before are
    looked up; the new ones of many texts are given to the library together.  A text's first part has no blank before it and
    is encoded by itself, and so is a whole text that holds the string of a special token, which the library finds before it
    splits.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        self.tokenizer, self.most = _tokenizer(path), most
        self.size = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for piece, number in vocabulary.items():
            self.lengths[number] = len(piece)  # byte-level pieces have one character a byte

    def _own_ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of new parts, which are joined and cut again by bytes.  What begins with white space does not join."""
        plain, rest = [], []
        for w in words:
            (plain if w and w[0] > " " and not w[0].isspace() else rest).append(w)
        for w, ids in zip(rest, self._own_ids([" " + w for w in rest]), strict=True):
            self.known[w] = np.array(ids, f"<u{self.size}").tobytes()
        joined = ["".join([" " + w for w in plain[at : at + JOINED]]) for at in range(0, len(plain), JOINED)]
        ids = np.array([i for own in self._own_ids(joined) for i in own], np.int64)
        ends = np.cumsum(self.lengths[ids])
        sizes = np.fromiter((len(w.encode()) + 1 for w in plain), np.int64, len(plain))
        cuts = (np.searchsorted(ends, np.cumsum(sizes)) + 1).tolist()
        packed = ids.astype(f"<u{self.size}").tobytes()
        begin = 0
        for word, end in zip(plain, cuts, strict=True):
            self.known[word] = packed[begin * self.size : end * self.size]
            begin = end

    def _lookup(self, words: list[str]) -> list[bytes]:
        missing = [w for w in words if w not in self.known]
        if missing and len(self.known) + len(missing) > self.most:
            # The words of the generation before stay at hand; what is still used moves over.
            self.old, self.known = self.known, {}
            missing = words
        new = []
        for word in missing:
            if (ids := self.old.get(word)) is None:
                new.append(word)
            else:
                self.known[word] = ids
        self._learn(new)
        return [self.known[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (and the end)."""
        whole = np.zeros(len(texts), bool)
        for content in self.special:
            whole |= pc.match_substring(texts, content).fill_null(False).to_numpy(zero_copy_only=False)
        parts, index, at = split_parts(texts, whole)
        first = at[:-1][np.diff(at) > 0]
        inner = np.ones(len(index), bool)
        inner[first] = False
        used = np.flatnonzero(np.bincount(index[inner], minlength=len(parts)))
        held = self._lookup(parts.take(pa.array(used)).to_pylist())
        held += [np.array(x, f"<u{self.size}").tobytes() for x in self._own_ids(parts.take(pa.array(index[first])).to_pylist())]
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // self.size
        place = np.zeros(len(parts), np.int64)
        place[used] = np.arange(len(used))
        own = place[index]
        own[first] = len(used) + np.arange(len(first))
        ids = ragged(np.frombuffer(b"".join(held), f"<u{self.size}"), (np.cumsum(sizes) - sizes)[own], sizes[own])
        return ids, np.concatenate([[0], np.cumsum(sizes[own])])[at]


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordwiseEncoder:
    """One for all tasks of a Python worker, so that each begins with the words of those before."""
    return WordwiseEncoder(path)


@dataclass
class TokenStore:
    folder: str  # of shards/ and index/
    id_bytes: int
    rows: DataFrame  # doc_id, copy, shard, place, n
    shards: DataFrame  # shard, name, start, tokens
    segments: DataFrame  # segment, name
    n_segments: int


def _write_shards(folder: str, path: str, end_id: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        end = np.array([end_id], f"<u{encoder.size}").tobytes()
        part, shard = TaskContext.get().partitionId(), 0
        ids, sizes, held = [], [], []

        def flush() -> pa.RecordBatch:
            name = put(f"{folder}/shards", f"{part:06d}-{shard:04d}", b"".join(ids))
            n = np.array(sizes, np.int64)
            keys = pa.chunked_array(held).combine_chunks()
            same = lambda value, kind: pa.array([value] * len(n), kind)
            return pa.RecordBatch.from_arrays(
                [keys, same(part, pa.int32()), same(shard, pa.int32()), same(name, pa.string()), pa.array(np.cumsum(n) - n), pa.array(n)],
                ["k", "part", "local", "name", "place", "n"],
            )

        total = 0
        for whole in batches:
            for batch in slices(whole, "t", SLICE_BYTES):
                begin = 0
                found, at = encoder.encode(batch.column(1))
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    ids += (found[a:b].tobytes(), end)
                    sizes.append(b - a + 1)
                    total += (b - a + 1) * encoder.size
                    if total >= shard_bytes:
                        held.append(batch.column(0).slice(begin, i + 1 - begin))
                        yield flush()
                        begin, shard, total = i + 1, shard + 1, 0
                        ids, sizes, held = [], [], []
                held.append(batch.column(0).slice(begin))
        if sizes:
            yield flush()

    return run


def _build_segment(folder: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = lambda name: table.column(name).to_numpy()
        keys, prints = column("h").view(np.uint64), column("p").view(np.uint64)
        # Keys with one hash are told apart by the whole second one, in a list after the records.
        _, number, times = np.unique(keys, return_inverse=True, return_counts=True)
        single = times[number] == 1
        hashed = PerfectHash.build(keys[single])
        at = hashed.find(keys[single])
        records, twins = np.zeros(len(hashed), RECORD), np.zeros(int((~single).sum()), TWIN)
        records["print"][at] = (prints[single] >> np.uint64(32)).astype("<u4")
        twins["h"], twins["p"] = keys[~single], prints[~single]
        for name in ("shard", "place", "n"):
            records[name][at], twins[name] = column(name)[single], column(name)[~single]
        segment = int(column("segment")[0])
        name = put(f"{folder}/index", f"{segment:06d}", hashed.to_bytes() + records.tobytes() + twins.tobytes())
        return pa.table({"segment": pa.array([segment], pa.int64()), "name": [name]})

    return run


def _key_hashes(doc_id: str = "doc_id", copy: str = "copy") -> list:
    return [F.xxhash64(F.lit("key"), doc_id, copy).alias("h"), F.xxhash64(F.lit("print"), copy, doc_id).alias("p")]


def write_store(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES
) -> TokenStore:
    """Encode every whole text and write shards and index under the shared folder.

    Documents are dealt to tasks by ranges of (id, hash of the text), so equal ids do not meet in one
    task for being equal; only the small rows of the listing are shuffled after that.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "tokens")
    plain = docs.select(col(doc_id).alias("k"), col(text).cast("string").alias("t"))
    total = scalar(plain.agg(F.sum(F.octet_length("t").cast("bigint"))))[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    order = [F.col("k").asc_nulls_last(), F.xxhash64("t")]
    ranged = plain.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kind = docs.schema[doc_id].dataType.simpleString()
    listing = written(
        ranged.mapInArrow(
            _write_shards(folder, tokenizer_path, end_id, shard_bytes),
            f"k {kind}, part int, local int, name string, place bigint, n bigint",
        ),
        "listing",
    )
    # One row for each shard of 16 MB from here on.
    shards = listing.groupBy("part", "local", "name").agg(F.sum("n").alias("tokens"))
    in_order = Window.orderBy("part", "local")
    shards = written(
        shards.select(
            "part",
            "local",
            "name",
            "tokens",
            (F.row_number().over(in_order) - 1).alias("shard"),
            (F.sum("tokens").over(in_order) - F.col("tokens")).alias("start"),
        ),
        "shards",
    )
    rows = listing.join(shards.select("part", "local", "shard"), ["part", "local"])
    rows = rows.select(F.col("k").alias("doc_id"), "shard", "place", "n")
    if rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("copy", F.lit(0))
    else:
        copies = Window.partitionBy("doc_id").orderBy("shard", "place")
        rows = rows.withColumn("copy", F.row_number().over(copies) - 1)
    rows = written(rows, "rows")
    n_segments = max(1, -(-rows.count() // SEGMENT_KEYS))
    keyed = rows.select(*_key_hashes(), "shard", "place", "n").withColumn("segment", F.pmod("h", F.lit(n_segments)).cast("bigint"))
    segments = keyed.groupBy("segment").applyInArrow(_build_segment(folder), "segment bigint, name string")
    id_bytes = 2 if _tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
    return TokenStore(folder, id_bytes, rows, shards.select("shard", "name", "start", "tokens"), written(segments, "segments"), n_segments)


def _ask(folder: str):
    """Rows of one segment after the other to their records; keys that are not stored are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, hashed, records = None, None, None
        for batch in batches:
            names = batch.column(batch.schema.get_field_index("name"))
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)] if len(names) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if names[a].as_py() != name:
                    name = names[a].as_py()
                    data = get(f"{folder}/index", name)
                    hashed, at = PerfectHash.from_bytes(data)
                    records = np.frombuffer(data, RECORD, len(hashed), at)
                    twins = np.frombuffer(data, TWIN, offset=at + records.nbytes)
                    pairs = {(h, p): i for i, (h, p) in enumerate(zip(twins["h"].tolist(), twins["p"].tolist(), strict=True))}
                part = batch.slice(a, b - a)
                keys, prints = (part.column(i).to_numpy().view(np.uint64) for i in (2, 3))
                at = hashed.find(keys)
                known = at >= 0
                known[known] = records["print"][at[known]] == (prints[known] >> np.uint64(32)).astype("<u4")
                found = {x: np.where(known, records[x][np.where(known, at, 0)] if len(records) else 0, 0).astype(np.int64) for x in ("shard", "place", "n")}
                for i in np.flatnonzero(np.isin(keys, twins["h"])).tolist() if pairs else ():
                    twin = pairs.get((int(keys[i]), int(prints[i])))
                    known[i] = twin is not None
                    for x in found:
                        found[x][i] = 0 if twin is None else twins[x][twin]
                rows = pa.array(np.flatnonzero(known))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).take(rows), *[pa.array(found[x][known]) for x in ("shard", "place", "n")]],
                    ["doc_id", "copy", "shard", "place", "n"],
                )

    return run


def locate(store: TokenStore, keys: DataFrame) -> DataFrame:
    """Keys (doc_id, copy) to (doc_id, copy, shard, place, n) by the index; unknown keys have no row.

    A foreign key passes the stored fingerprint once in four billion.
    """
    asked = keys.select("doc_id", F.col("copy").cast("int").alias("copy"), *_key_hashes())
    asked = asked.withColumn("segment", F.pmod("h", F.lit(store.n_segments)).cast("bigint")).join(store.segments, "segment")
    asked = asked.select("doc_id", "copy", "h", "p", "name").repartition("name").sortWithinPartitions("name")
    kind = keys.schema["doc_id"].dataType.simpleString()
    return asked.mapInArrow(_ask(store.folder), f"doc_id {kind}, copy int, shard bigint, place bigint, n bigint")


def _read(folder: str, id_bytes: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids = None, None
        for batch in batches:
            shard_names, places, sizes = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            out = []
            for own, place, n in zip(shard_names, places, sizes, strict=True):
                if own != name:
                    name, ids = own, np.frombuffer(get(f"{folder}/shards", own), f"<u{id_bytes}")
                piece = ids[place : place + n].astype("<u4")
                out.append(zlib.crc32(piece) if digest else piece.astype("<i4"))
            values = pa.array(out, pa.int64()) if digest else pa.array(out, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(5), batch.column(4), values], ["doc_id", "copy", "start", "n_tokens", "ids"]
            )

    return run


def read_ids(store: TokenStore, keys: DataFrame, digest: bool = False) -> DataFrame:
    """Keys (doc_id, copy) to (doc_id, copy, start, n_tokens, ids), read from the shards by the index.

    ``start`` is the number of ids before the document in the whole store.  With ``digest`` the ids are
    their CRC-32 as unsigned 32-bit numbers (a long) instead of an array.
    """
    found = locate(store, keys).join(store.shards, "shard")
    found = found.select("doc_id", "copy", "name", "place", "n", (F.col("start") + F.col("place")).alias("start"))
    found = found.repartition("name").sortWithinPartitions("name", "place")
    kind = keys.schema["doc_id"].dataType.simpleString()
    ids = "bigint" if digest else "array<int>"
    return found.mapInArrow(
        _read(store.folder, store.id_bytes, digest), f"doc_id {kind}, copy int, start bigint, n_tokens bigint, ids {ids}"
    )
