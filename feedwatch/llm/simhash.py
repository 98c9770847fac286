"""SimHash near-duplicates: fingerprints, an inverted index on byte positions, count filtering.

Two fingerprints of eight bytes that differ in at most four bits agree in at least four of their
eight bytes.  Lists for single positional bytes would have at most 2,048 keys however many documents
there are, so the index is keyed by *triples* of positional bytes: 20 triples are enough for any four
positions to contain one of them whole (``covering_triples``).  Pairs that meet in a list are
tallied (number of equal positional bytes), those with four or more are verified bit by bit.

No list is cut.  Within a list only the links of a spanning forest leave the task, not all pairs.  A
list of over ``most`` distinct fingerprints is resolved in another exact way: fingerprints at four or
fewer bits have a common midpoint at two or fewer bits from both, and all fingerprints around one
midpoint are at four or fewer bits from each other, so each is linked to the smallest around each of
its 2,081 midpoints, which takes rows in proportion to the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwatch.llm.components import star_roots
from feedwatch.llm.tables import col, fresh, written
from feedwatch.llm.words import slices, text_buffer

BITS = 4  # fingerprints link at this many differing bits or fewer
SHARED = 4  # and then agree in at least this many of their eight bytes
WIDTH = 4  # words in a shingle
MOST = 2048  # distinct fingerprints of a list that are compared with each other in one task
SEED = 42
_LANES = np.uint64(0x0101010101010101)


def shingle_fingerprint(text: bytes, width: int = WIDTH) -> int:
    """SimHash of one UTF-8 text: each bit is 1 if over half of the shingle hashes have it."""
    words = text.lower().split()  # of bytes: only A-Z is lowered, only the six blanks split
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[s:e], SEED) for s, e in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)],
        np.uint64,
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; eight bit counters are added in one word."""
    counts = np.zeros(64, np.int64)
    blocks = np.arange(0, len(hashes), 255)
    for shift in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, blocks)
        counts[shift::8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in range(64) if 2 * counts[i] > len(hashes)))


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.schema.names[-1], 8 << 20):
                raw, at = text_buffer(batch.column(batch.num_columns - 1))
                raw = raw.tobytes()
                found = np.array(
                    [shingle_fingerprint(raw[s:e], width) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)],
                    np.uint64,
                )
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(found.view(np.int64))], [*batch.schema.names[:-1], "fp"]
                )

    return run


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """The columns ``keep`` (``doc_id`` by default) and ``fp``, a signed long holding the 64 bits.

    Null and blank texts have fingerprint zero; a text shorter than a shingle is one shingle.
    """
    keep = ["doc_id"] if keep is None else keep
    picked = docs.select(*[col(c).alias(f"k{i}") for i, c in enumerate(keep)], col(text).cast("string").alias("t"))
    kinds = ", ".join([*[f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)], "fp bigint"])
    out = picked.mapInArrow(_fingerprints(width), kinds)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("fp"))


def covering_triples() -> list[tuple[int, int, int]]:
    """20 triples of the eight byte positions; every four positions contain one of them.

    Turán's construction: positions in three groups, all triples within a group, and those with two
    in a group and one in the next.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    kept = []
    for triple in combinations(range(8), 3):
        counts = [sum(group[p] == g for p in triple) for g in range(3)]
        if 3 in counts or any(counts[g] == 2 and counts[(g + 1) % 3] == 1 for g in range(3)):
            kept.append(triple)
    return kept


def _postings(fps: DataFrame) -> DataFrame:
    """A row (key, fp) for each of the fingerprint's 20 triples of positional bytes."""

    def byte(p: int):
        return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))

    keys = [
        F.lit(k << 24) + F.shiftleft(byte(a), 16) + F.shiftleft(byte(b), 8) + byte(c)
        for k, (a, b, c) in enumerate(covering_triples())
    ]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of one list: tally equal bytes, keep enough, verify, connect."""
    size = len(fps)
    parents, children = [], []
    open_ = np.ones(size, bool)
    while open_.any():
        seed = int(np.argmax(open_))
        open_[seed] = False
        frontier = np.array([seed])
        while len(frontier) and open_.any():
            others = np.flatnonzero(open_)
            # Blocks keep the table of differences within a few MB.
            reached = np.full(len(others), -1)
            for at in range(0, len(frontier), 256):
                part = frontier[at : at + 256]
                differ = fps[part][:, None] ^ fps[others][None, :]
                equal = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=2)
                linked = (equal >= SHARED) & (np.bitwise_count(differ) <= bits)
                hit = linked.any(axis=0) & (reached < 0)
                reached[hit] = part[linked[:, hit].argmax(axis=0)]
            hit = reached >= 0
            parents.append(fps[reached[hit]])
            children.append(fps[others[hit]])
            frontier = others[hit]
            open_[frontier] = False
    if not parents:
        return fps[:0], fps[:0]
    return np.concatenate(parents), np.concatenate(children)


def _links(bits: int, most: int):
    """Rows sorted by key to links (a, b); rows of longer lists come back as (fp, null)."""

    def emit(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        left = pa.array(a.view(np.int64))
        right = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([left, right], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, long_list = None, np.zeros(0, np.uint64), False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column(0).to_numpy()
            fps = batch.column(1).to_numpy().view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            parents, children, over = [], [], []

            sizes = np.diff(cuts)
            last = len(sizes) - 1
            for i in np.flatnonzero((sizes > 1) | np.isin(np.arange(last + 1), (0, last))):
                key, part = keys[cuts[i]], fps[cuts[i] : cuts[i + 1]]
                if key == held_key:
                    held = np.concatenate([held, part])
                else:
                    if len(held) > 1:
                        a, b = _forest(held, bits)
                        parents.append(a)
                        children.append(b)
                    held_key, held, long_list = key, part, False
                if long_list or len(held) > most:
                    over.append(held)
                    held, long_list = held[:0], True
            if over:
                yield emit(np.concatenate(over), None)
            if parents:
                yield emit(np.concatenate(parents), np.concatenate(children))
        if len(held) > 1:
            yield emit(*_forest(held, bits))

    return run


def _midpoint_links(fps: DataFrame) -> DataFrame:
    """Links of fingerprints in long lists, through their midpoints at two bits or fewer."""
    one = [1 << i for i in range(64)]
    flips = [0, *one, *[a | b for a, b in combinations(one, 2)]]
    signed = [x - (1 << 64) if x >> 63 else x for x in flips]
    rows = fps.select("fp", F.explode(F.array(*map(F.lit, signed))).alias("flip"))
    rows = rows.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    least = rows.groupBy("mid").agg(F.min("fp").alias("b"), F.max("fp").alias("m")).where("b <> m")
    return rows.join(least.select("mid", "b"), "mid").where("fp <> b").select(F.col("fp").alias("a"), "b")


def fingerprint_links(fps: DataFrame, bits: int = BITS, most: int = MOST) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs at ``bits`` bits or fewer."""
    if not 0 <= bits <= BITS:
        raise ValueError("four shared bytes are guaranteed for up to four differing bits only")
    postings = _postings(fps).repartition("key").sortWithinPartitions("key")
    found = written(postings.mapInArrow(_links(bits, most), "a bigint, b bigint"), "links")
    links = found.where("b is not null")
    over = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if over.isEmpty():
        return links
    if bits != BITS:
        raise ValueError("midpoints at two bits are exact for four bits only")
    return links.unionByName(_midpoint_links(over))


def near_duplicates(marked: DataFrame, doc_id: str = "doc_id", bits: int = BITS, most: int = MOST) -> DataFrame:
    """Rows with ``fp`` to rows (fp, root, component_id), one for each distinct fingerprint.

    ``root`` names the component; ``component_id`` is the smallest id of the documents reachable over links, null where none has
    an id.  Equal fingerprints count once, so groups of exact copies of any size add nothing.
    """
    fps = written(marked.groupBy("fp").agg(F.min(col(doc_id)).alias("rep")), "fingerprints")
    roots = star_roots(fingerprint_links(fps.select("fp"), bits, most))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "root", "component_id")


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``."""
    marked = written(fingerprints(docs), "marked")
    classes = near_duplicates(marked)
    return marked.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def simhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group of near-duplicates, with all its columns.

    The row with the smallest id stays; among rows with that same id (repeated rows) the one that was
    read first.  Rows without an id come after all others.  Blank texts have fingerprint zero and
    are one group, like any other.
    """
    row = fresh("fw_row", docs.columns)
    held = written(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    marked = written(fingerprints(held, text, [row, doc_id]).toDF("row", "id", "fp"), "marked")
    classes = near_duplicates(marked, "id")
    first = marked.join(classes, "fp").groupBy("root").agg(
        F.min(F.struct(F.isnull("id").alias("last"), "id", "row")).alias("kept")
    )
    kept = first.select(F.col("kept.row").alias(row))
    return held.join(kept, row, "left_semi").select(*map(col, docs.columns))
