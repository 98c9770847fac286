"""MinHash near-duplicates: b-bit signatures, a multi-index Hamming join, links confirmed on full sets.

A text's set of shingles is sketched by ``CHUNKS`` x ``SYMBOLS`` min-hashes, of which ``BITS`` bits are kept.  The signature
distance is the number of symbols that differ.  Signatures are split into chunks: if two are at distance d, one
chunk has at most d / ``CHUNKS`` errors, so with ``ERRORS`` = 1 error allowed in a chunk every pair at a distance below
(``ERRORS`` + 1) x ``CHUNKS`` = 28 of 84 agrees in all symbols but one of some chunk.  The allowed errors are enumerated on
the index side: each chunk is posted once for each symbol that may be wrong, under the hash of the others (84 keys
a set), and two signatures within the distance meet in a list.  At similarity 0.8 the expected distance is 17; pairs
beyond 27 may meet as well, and none is thrown away for its distance: a pair at exactly 0.8 fails to meet
with probability 3 in 10 million (``miss``).

What meets is compared exactly, on the whole sets; nothing is linked by its sketch.  No list is cut.
First each list's members are compared with its smallest one, which takes rows in proportion to the members and settles the usual
list.  In the others, members that are in different components by then are left over.  Lists that hang together are
solved in one task while their sets are within ``MOST`` shingles, and each by itself beyond that; there each set outside the
largest component is compared with what shares one of its rarest shingles (two sets of similarity s share one of
the (1 - s) n + 1 rarest of either).  A list too large for a task has its next members compared with all others, as before,
until it is small.  Only links leave the task, not pairs.

Contracts: words are runs of characters other than the six ASCII blanks, A-Z lowered.  A text of fewer words than a shingle is one
shingle; a null or blank one has the empty set, and is linked with nothing.  Equal sets are one node, so exact copies
of any number add nothing.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwatch.llm.components import star_roots
from feedwatch.llm.tables import col, written
from feedwatch.llm.words import mix, slices, text_buffer, window_hashes, word_hashes, word_spans

U = np.uint64
WIDTH = 4  # words in a shingle
LEAST = (80, 100)  # least similarity, as a fraction
CHUNKS = 14
SYMBOLS = 6  # min-hashes in a chunk
ERRORS = 1  # symbols of a chunk that may differ
BITS = 16  # kept of a min-hash
MOST = 4_000_000  # shingles of the sets that one task compares
SLICE_BYTES = 8 << 20
_SIZE = CHUNKS * SYMBOLS
_DRAWS = np.random.default_rng(11).integers(0, 1 << 32, (2, _SIZE, 1), np.uint32)
_FLIPS, _FACTORS = _DRAWS[0], _DRAWS[1] | np.uint32(1)
_SPREAD = np.uint32(0x9E3779B1)
_STEP = U(0x9E3779B97F4A7C15)


def miss(similarity: float) -> float:
    """Probability that a pair of this similarity meets in no list."""
    meets = sum(comb(SYMBOLS, k) * (1 - similarity) ** k * similarity ** (SYMBOLS - k) for k in range(ERRORS + 1))
    return (1 - meets) ** CHUNKS


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Each text's sorted different shingle hashes."""
    raw, at = text_buffer(texts)
    raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
    starts, ends, first = word_spans(raw, at)
    hashes = word_hashes(raw, starts, ends)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        size = min(width, b - a)
        yield np.unique(window_hashes(hashes[a:b], size, size)) if size else hashes[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """``BITS`` bits of each of the min-hashes of one set."""
    short = (shingles >> U(32)).astype(np.uint32)
    least = np.full(_SIZE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, ((short[None, at : at + 512] ^ _FLIPS) * _FACTORS).min(axis=1), out=least)
    return ((least * _SPREAD) >> np.uint32(32 - BITS)).astype(np.uint16)


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys of signatures (one a row): for each chunk and each choice of wrong symbols, a hash of the others."""
    chunks = signatures.reshape(len(signatures), CHUNKS, SYMBOLS).astype(U)
    out = []
    for number, wrong in enumerate(combinations(range(SYMBOLS), ERRORS)):
        key = mix(np.arange(CHUNKS, dtype=U) * U(997) + U(number + 1)) + np.zeros((len(chunks), 1), U)
        for place in range(SYMBOLS):
            if place not in wrong:
                key = mix(key * _STEP ^ chunks[:, :, place])
        out.append(key)
    return np.concatenate(out, axis=1).view(np.int64) if len(chunks) else np.zeros((0, 0), np.int64)


def similar(shared, a, b):
    """Whether sets of sizes ``a`` and ``b`` with ``shared`` common shingles have the least similarity, in whole numbers."""
    return LEAST[1] * shared >= LEAST[0] * (a + b - shared)


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, t) to (row, id, d1, d2, n, signature): 128 bits and size of the set, no signature for the empty set."""
    for whole in batches:
        for batch in slices(whole, "t", SLICE_BYTES):
            one, two, sizes, prints = [], [], [], []
            for shingles in shingle_sets(batch.column(2)):
                one.append(int(mix(shingles ^ U(1)).sum(dtype=U).view(np.int64)))
                two.append(int(mix(shingles ^ U(2)).sum(dtype=U).view(np.int64)))
                sizes.append(len(shingles))
                prints.append(signature(shingles).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())],
                ["row", "id", "d1", "d2", "n", "signature"],
            )


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, n, signature) to (node, n, keys)."""
    for batch in batches:
        held = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(batch.num_rows, _SIZE)
        keys = index_keys(held)
        ends = np.arange(len(keys) + 1, dtype=np.int32) * (keys.shape[1] if len(keys) else 0)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["node", "n", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "t", SLICE_BYTES):
            found = [x.tobytes() for x in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, sa, sb) to the pairs (a, b) of similar sets."""
    for batch in batches:
        keep, known, own = [], None, None
        for a, left, right in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if a != known:
                known, own = a, np.frombuffer(left.as_buffer(), U)
            other = np.frombuffer(right.as_buffer(), U)
            place = np.minimum(np.searchsorted(own, other), len(own) - 1)
            keep.append(bool(similar(int((own[place] == other).sum()), len(own), len(other))))
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])


def _solve(table: pa.Table) -> pa.Table:
    """Sets (node, root, shingles) of one group to links that connect all similar pairs of different roots."""
    nodes = table.column("node").to_numpy()
    _, component = np.unique(table.column("root").to_numpy(), return_inverse=True)
    sets = [np.frombuffer(x.as_buffer(), U) for x in table.column("shingles")]
    sizes = np.array([len(x) for x in sets])
    _, numbers, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(numbers, kind="stable")
    holders, begin = owner[order], np.concatenate([[0], np.cumsum(times)])
    cuts = np.concatenate([[0], np.cumsum(sizes)])

    def met(shingles: np.ndarray) -> np.ndarray:
        return np.concatenate([holders[begin[x] : begin[x + 1]] for x in shingles.tolist()])

    found = []
    largest = np.bincount(component).argmax()
    for i in np.flatnonzero(component != largest).tolist():
        own = numbers[cuts[i] : cuts[i + 1]]
        needed = -(-LEAST[0] * sizes[i] // LEAST[1])  # shared with any similar set
        rare = own[np.argsort(times[own], kind="stable")[: sizes[i] - needed + 1]]
        others = np.unique(met(rare[times[rare] > 1])) if (times[rare] > 1).any() else rare[:0]
        if not (component[others] != component[i]).any():
            continue
        shared = np.bincount(met(own), minlength=len(sets))
        linked = np.flatnonzero(similar(shared, sizes[i], sizes) & (component != component[i]))
        for j in linked.tolist():
            if component[j] != component[i]:
                found.append((int(nodes[i]), int(nodes[j])))
                component[component == component[j]] = component[i]
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _with_leads(members: DataFrame) -> DataFrame:
    """Members (key, node, n) of lists of two or more, with the smallest node of the list."""
    leads = members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("l"), F.max("node").alias("last"))
    leads = leads.where("l.node <> last").select("key", F.col("l.node").alias("lead"), F.col("l.n").alias("lead_n"))
    return members.join(leads, "key")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    right = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = right.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    return written(both.select("a", "b", "sa", "sb").mapInArrow(_confirm, "a bigint, b bigint"), "links")


def _grouped(open_: DataFrame, most: int) -> DataFrame:
    """Open members (key, node, n, root) with the group they are solved in and the shingles of its sets."""
    leads = open_.groupBy("key").agg(F.min("node").alias("b"))
    roots = star_roots(open_.join(leads, "key").select(F.col("node").alias("a"), "b"))
    placed = open_.join(roots.withColumnRenamed("root", "cluster"), "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    clusters = placed.select("cluster", "node", "n").distinct().groupBy("cluster").agg(F.sum("n").alias("cluster_n"))
    lists = placed.groupBy("key").agg(F.sum("n").alias("list_n"))
    placed = placed.join(clusters, "cluster").join(lists, "key")
    together = F.col("cluster_n") <= most
    return placed.select(
        "key", "node", "n", "root",
        F.struct(together.alias("together"), F.when(together, F.col("cluster")).otherwise(F.col("key")).alias("number")).alias("group"),
        (together | (F.col("list_n") <= most)).alias("fits"),
    )


def similar_links(texts: DataFrame, nodes: DataFrame, width: int = WIDTH, most: int = MOST) -> DataFrame:
    """Links (a, b) that connect all similar pairs that meet in a list.

    ``nodes`` has (node, n, signature), ``texts`` (row, t) with the text of each node among its rows.
    """
    keyed = nodes.mapInArrow(_post, "node bigint, n bigint, keys array<bigint>")
    members = written(_with_leads(keyed.select(F.explode("keys").alias("key"), "node", "n")), "lists")
    involved = members.select("node").distinct()
    chosen = texts.join(involved.withColumnRenamed("node", "row"), "row", "left_semi").select(F.col("row").alias("node"), "t")
    sets = written(chosen.mapInArrow(_sets, "node bigint, shingles binary"), "sets")
    found = []
    while True:
        near = members.where("node <> lead").where(LEAST[1] * F.least("n", "lead_n") >= LEAST[0] * F.greatest("n", "lead_n"))
        found.append(_confirmed(near.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), sets))
        links = reduce(DataFrame.unionByName, found)
        rest = members.where("node <> lead").select("key", "node", "n")
        rest = rest.join(star_roots(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        unsettled = rest.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        open_ = written(rest.join(unsettled, "key", "left_semi"), "open")
        if open_.isEmpty():
            return links
        placed = written(_grouped(open_, most), "groups")
        small = placed.where("fits").select("group", "node", "root").distinct().join(sets, "node")
        found.append(written(small.groupBy("group").applyInArrow(_solve, "a bigint, b bigint"), "links"))
        large = placed.where("not fits").select("key", "node", "n")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, found)
        members = written(_with_leads(large), "lists")


def minhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", most: int = MOST) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    ``component_id`` is the smallest id of the documents reachable over links, null where none has an id; ``kept`` says that it is the
    row's own (rows without an id are kept if their component has none; repeated rows are kept or dropped together).
    """
    row = F.monotonically_increasing_id()
    kind = docs.schema[doc_id].dataType.simpleString()
    held = written(docs.select(col(doc_id).alias("id"), col(text).cast("string").alias("t")).withColumn("row", row), "texts")
    marked = held.select("row", "id", "t").mapInArrow(_mark, f"row bigint, id {kind}, d1 bigint, d2 bigint, n bigint, signature binary")
    marked = written(marked, "marked")
    nodes = marked.where("n > 0").groupBy("d1", "d2").agg(
        F.min(F.struct("row", "n", "signature")).alias("x"), F.min("id").alias("low")
    )
    nodes = written(nodes.select("d1", "d2", "low", "x.*").withColumnRenamed("row", "node"), "nodes")
    links = similar_links(held.select("row", "t"), nodes.select("node", "n", "signature"), most=most)
    rooted = nodes.join(star_roots(links), "node", "left").select("d1", "d2", "low", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(lowest, "root").select("d1", "d2", "component_id")
    own = marked.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "d1", "d2")
    joined = own.where("n_shingles > 0").join(classes, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    alone = own.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
