"""Nearest neighbours by cosine: a graph built with NN-descent, and greedy search in it.

Equal vectors are one node, so copies of any number cost nothing.  Nodes are dealt to blocks by a hash, and
one row holds a block: its vectors (single precision, of length one) and its neighbour lists.  Nearness is minus the
squared distance of these, taken from differences or about the centre of what is compared, so near copies are told apart
as well as other vectors are.

*Building.*  Lists begin with neighbours found in small groups: random ones, and those that fall on the
same side of random hyperplanes.  Each round joins neighbours of neighbours: every node brings those that
it lists and those that list it together, all their pairs with a new member are compared, and a node
takes over what is nearer than what it has.  Vectors travel once to each block that needs them.

*Search.*  Queries are nodes too: a query's pool begins with its own list.  Each round expands the nearest
nodes of the pool not expanded yet, in both directions of the graph, scores what is new, and keeps the
best ``POOL``; it ends when all of the pool is expanded.  What is left is scored exactly, in
double precision on the original vectors.

Vectors that are null, zero, of another length than most, or hold null or non-finite numbers take no part,
nor do rows without an id.  Repeated rows (same id, same vector) count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedwatch.llm.tables import col, scalar, written
from feedwatch.llm.words import mix

U = np.uint64
LIST = 24  # neighbours a node keeps
BLOCK = 2048  # nodes of a block, on average
TREES = 10  # groupings by random hyperplanes
LEAF = 128  # nodes of such a group, on average; over four times as many are cut by further planes
TASK_NODES = 1 << 16  # of one group in one task; a larger one is dealt out at random, otherwise in each grouping
FAR = -5.0  # below any nearness
GROUP = 64  # pairs are compared within this many neighbours; a node with more has several groups
ROUNDS = 6
DONE = 0.002  # a round that changes a smaller share of all lists' entries is the last
POOL = 160
EXPAND = 24
SEARCH_ROUNDS = 30
TOP = 5

GRAPH = "block bigint, nodes binary, vectors binary, lists binary, sims binary, fresh binary"


def _block(nodes: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(nodes.view(U)) % U(blocks)).astype(np.int64)


def _raw(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


class Part:
    """One block of the graph: rows of nodes in ascending order."""

    def __init__(self, table: pa.Table):
        get = lambda name, kind: np.frombuffer(table.column(name)[0].as_py(), kind)
        self.block = table.column("block")[0].as_py()
        self.nodes = get("nodes", np.int64)
        n = len(self.nodes)
        self.vectors = get("vectors", np.float32).reshape(n, -1)
        self.lists = get("lists", np.int64).reshape(n, LIST)
        self.sims = get("sims", np.float32).reshape(n, LIST)
        self.fresh = get("fresh", np.bool_).reshape(n, LIST)


def _graph_row(block: int, nodes, vectors, lists, sims, fresh) -> pa.Table:
    values = [pa.array([block], pa.int64()), *[pa.array([_raw(x)], pa.binary()) for x in (nodes, vectors, lists, sims, fresh)]]
    return pa.table(values, names=["block", "nodes", "vectors", "lists", "sims", "fresh"])


def _vectors(column: pa.Array) -> np.ndarray:
    """Lists of one length to a matrix of doubles."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Distinct rows (vec_id, v) that take part; ``v`` is an array of doubles."""
    v = F.transform(col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    rows = table.select(col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0.0))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return rows.where(F.size("v") == F.lit(lengths["n"] if lengths else 0)).distinct()


def _unit(blocks: int):
    """Batches (node, v) to (block, node, vector): of length one, in single precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            matrix = _vectors(batch.column(1))
            # Scaling by the largest entry first keeps squares within range.
            matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True) if len(matrix) else matrix
            matrix = (matrix / np.linalg.norm(matrix, axis=1, keepdims=True)).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_block(nodes, blocks)), batch.column(0), pa.array([r.tobytes() for r in matrix], pa.binary())],
                ["block", "node", "vector"],
            )

    return run


def _top(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Rows to keep: each owner's ``most`` best different others, sorted by owner, nearest first."""
    order = np.lexsort((-sim, other, owner))
    o, t = owner[order], other[order]
    new = np.ones(len(order), bool)
    new[1:] = (o[1:] != o[:-1]) | (t[1:] != t[:-1])
    order = order[new]
    order = order[np.lexsort((other[order], -sim[order], owner[order]))]
    o = owner[order]
    begins = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]])) if len(o) else np.zeros(0, np.int64)
    place = np.arange(len(o)) - np.repeat(begins, np.diff(np.append(begins, len(o))))
    return order[place < most]


def _proposals(blocks: int, targets: np.ndarray, others: np.ndarray, sims: np.ndarray) -> pa.Table:
    """Nearer neighbours found, one row for each block of targets."""
    keep = _top(targets, others, sims, LIST)
    targets, others, sims = targets[keep], others[keep], sims[keep]
    home = _block(targets, blocks)
    order = np.argsort(home, kind="stable")
    home = home[order]
    cuts = [0, *(np.flatnonzero(np.diff(home)) + 1).tolist(), len(home)] if len(home) else []
    pairs = list(zip(cuts, cuts[1:], strict=False))
    cut = lambda x: pa.array([_raw(x[order][a:b]) for a, b in pairs], pa.binary())
    return pa.table(
        {"block": pa.array([int(home[a]) for a, _ in pairs], pa.int64()), "targets": cut(targets), "others": cut(others), "sims": cut(sims)}
    )


PROPOSALS = "block bigint, targets binary, others binary, sims binary"


def _leaf(trees: int, bits: int, groups: int, salt: int):
    """Batches (block, node, vector) to (tree, leaf, node, vector); the leaves of tree -1 are random groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(np.float32)
            random = _block(batch.column(1).to_numpy() ^ salt, groups)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, -1)), pa.array(random), batch.column(1), batch.column(2)], ["tree", "leaf", "node", "vector"]
            )
            for tree in range(trees):
                planes = np.random.default_rng((salt, tree)).normal(size=(matrix.shape[1], max(bits, 1))).astype(np.float32)
                leaf = ((matrix @ planes) > 0) @ (1 << np.arange(max(bits, 1))) if bits else np.zeros(len(matrix), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, tree)), pa.array(leaf.astype(np.int64)), batch.column(1), batch.column(2)],
                    ["tree", "leaf", "node", "vector"],
                )

    return run


def _nearness(vectors: np.ndarray) -> np.ndarray:
    """Minus the squared distances of all pairs, about their centre."""
    vectors = vectors - vectors.mean(axis=0)
    squares = np.einsum("ij,ij->i", vectors, vectors)
    return np.minimum(2 * (vectors @ vectors.T) - squares[:, None] - squares[None, :], 0)


def _halved(vectors: np.ndarray, size: int, seed: tuple) -> Iterator[np.ndarray]:
    """Row numbers in groups of ``size`` at most: cut in half, again and again, between two members drawn at random."""
    rng = np.random.default_rng(seed)
    left = [np.arange(len(vectors))]
    while left:
        rows = left.pop()
        if len(rows) <= size:
            yield rows
            continue
        one, two = vectors[rng.choice(rows, 2, replace=False)]
        along = (vectors[rows] - one) @ (two - one)
        order = np.argpartition(along, len(rows) // 2)
        left += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]


def _compare(nodes: np.ndarray, vectors: np.ndarray, groups: Iterator[np.ndarray], most: int) -> tuple[list, list, list]:
    """Each node's best others within its group."""
    targets, others, sims = [], [], []
    for part in groups:
        if len(part) > 1:
            table = _nearness(vectors[part])
            np.fill_diagonal(table, -np.inf)
            k = min(most, len(part) - 1)
            best = np.argpartition(-table, k - 1, axis=1)[:, :k]
            targets.append(np.repeat(nodes[part], k))
            others.append(nodes[part][best].ravel())
            sims.append(np.take_along_axis(table, best, 1).ravel())
    return targets, others, sims


def _start(table: pa.Table, blocks: int) -> pa.Table:
    """Neighbours within one leaf.  Those of tree -1 are random: every node gets some neighbours."""
    nodes = table.column("node").to_numpy()
    vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32).reshape(len(nodes), -1)
    tree, leaf = table.column("tree")[0].as_py(), table.column("leaf")[0].as_py()
    if tree < 0:
        groups = np.array_split(np.argsort(mix(nodes.view(U))), max(1, len(nodes) // GROUP))
    else:
        groups = _halved(vectors, 4 * LEAF, (tree, leaf))
    found = _compare(nodes, vectors, groups, LIST)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return _proposals(blocks, join(found[0], np.int64), join(found[1], np.int64), join(found[2], np.float32))


def _empty_lists(table: pa.Table) -> pa.Table:
    nodes = table.column("node").to_numpy()
    order = np.argsort(nodes)
    vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32).reshape(len(nodes), -1)[order]
    shape = (len(nodes), LIST)
    return _graph_row(
        table.column("block")[0].as_py(), nodes[order], vectors, np.full(shape, -1, np.int64), np.full(shape, FAR, np.float32), np.zeros(shape, bool)
    )


def _flat(table: pa.Table, names: tuple[str, ...], kinds: tuple) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table.column(n).to_pylist()), k) for n, k in zip(names, kinds, strict=True)]


def _take_over(graph: pa.Table, found: pa.Table) -> pa.Table:
    """A block with the nearer neighbours found for it; ``fresh`` marks those that are new."""
    part = Part(graph)
    targets, others, sims = _flat(found, ("targets", "others", "sims"), (np.int64, np.int64, np.float32))
    row = np.searchsorted(part.nodes, targets)
    old = part.lists >= 0
    owner = np.concatenate([np.nonzero(old)[0], row])
    other = np.concatenate([part.lists[old], others])
    sim = np.concatenate([part.sims[old], sims])
    new = np.concatenate([np.zeros(int(old.sum()), bool), np.ones(len(row), bool)])
    # What is listed already stays first among equals and keeps its mark.
    order = np.lexsort((new, other, owner))
    first = np.ones(len(order), bool)
    first[1:] = (owner[order][1:] != owner[order][:-1]) | (other[order][1:] != other[order][:-1])
    order = order[first]
    owner, other, sim, new = owner[order], other[order], sim[order], new[order]
    keep = _top(owner, other, sim, LIST)
    owner, other, sim, new = owner[keep], other[keep], sim[keep], new[keep]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    lists = np.full(part.lists.shape, -1, np.int64)
    best = np.full(part.lists.shape, FAR, np.float32)
    fresh = np.zeros(part.lists.shape, bool)
    lists[owner, place], best[owner, place], fresh[owner, place] = other, sim, new
    return _graph_row(part.block, part.nodes, part.vectors, lists, best, fresh)


def _edges(blocks: int):
    """Blocks to rows (block, members, pivots, fresh): who brings whom together, both ways."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = Part(pa.Table.from_batches([batch.slice(i, 1)]))
                rows, cols = np.nonzero(part.lists >= 0)
                own, other, fresh = part.nodes[rows], part.lists[rows, cols], part.fresh[rows, cols]
                members, pivots, marks = np.concatenate([other, own]), np.concatenate([own, other]), np.concatenate([fresh, fresh])
                home = _block(members, blocks)
                order = np.argsort(home, kind="stable")
                cuts = np.flatnonzero(np.diff(home[order], prepend=-1, append=-1))
                pairs = list(zip(cuts.tolist(), cuts.tolist()[1:], strict=False))
                cut = lambda x: pa.array([_raw(x[order][a:b]) for a, b in pairs], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(home[order[a]]) for a, _ in pairs], pa.int64()), cut(members), cut(pivots), cut(marks)],
                    ["block", "members", "pivots", "fresh"],
                )

    return run


def _bring(edges: pa.Table, graph: pa.Table, blocks: int) -> pa.Table:
    """Members' vectors, once for each block of pivots: (block, members, vectors, limits, counts, pivots, fresh)."""
    part = Part(graph)
    members, pivots, fresh = _flat(edges, ("members", "pivots", "fresh"), (np.int64, np.int64, np.bool_))
    home = _block(pivots, blocks)
    order = np.lexsort((pivots, members, home))
    members, pivots, fresh, home = members[order], pivots[order], fresh[order], home[order]
    limit = part.sims[:, -1]
    out: dict[str, list] = {"block": [], "members": [], "vectors": [], "limits": [], "counts": [], "pivots": [], "fresh": []}
    cuts = np.flatnonzero(np.diff(home, prepend=-1, append=-1)).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        different, counts = np.unique(members[a:b], return_counts=True)
        row = np.searchsorted(part.nodes, different)
        out["block"].append(int(home[a]))
        for name, value in zip(list(out)[1:], (different, part.vectors[row], limit[row], counts, pivots[a:b], fresh[a:b]), strict=True):
            out[name].append(_raw(value))
    return pa.table([pa.array(v, pa.int64() if n == "block" else pa.binary()) for n, v in out.items()], names=list(out))


def _local_join(table: pa.Table, blocks: int, salt: int) -> pa.Table:
    """For each pivot of a block, compare its members pairwise; nearer ones are proposed both ways.

    The members of a pivot with many are grouped otherwise in each round (``salt``).
    """
    members, limits, counts, pivots, fresh = _flat(
        table, ("members", "limits", "counts", "pivots", "fresh"), (np.int64, np.float32, np.int64, np.int64, np.bool_)
    )
    vectors = np.frombuffer(b"".join(table.column("vectors").to_pylist()), np.float32).reshape(len(members), -1).astype(np.float32)
    which = np.repeat(np.arange(len(members)), counts)
    order = np.lexsort((mix(members[which].view(U) ^ U(salt)), pivots))
    which, pivots, fresh = which[order], pivots[order], fresh[order]
    begins = np.flatnonzero(np.diff(pivots, prepend=pivots[0] - 1 if len(pivots) else 0))
    targets, others, sims = [], [], []
    for a, b in zip(begins.tolist(), np.append(begins[1:], len(pivots)).tolist(), strict=True):
        for at in range(a, b, GROUP):
            rows, new = which[at : min(at + GROUP, b)], fresh[at : min(at + GROUP, b)]
            if len(rows) < 2 or not new.any():
                continue
            table_ = _nearness(vectors[rows])
            better = (table_ > limits[rows][:, None]) & (new[:, None] | new[None, :]) & (members[rows][:, None] != members[rows][None, :])
            i, j = np.nonzero(better)
            targets.append(members[rows[i]])
            others.append(members[rows[j]])
            sims.append(table_[i, j])
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return _proposals(blocks, join(targets, np.int64), join(others, np.int64), join(sims, np.float32))


def _fresh_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [int(np.frombuffer(x.as_py(), np.bool_).sum()) for x in batch.column(0)]
        yield pa.RecordBatch.from_pydict({"n": pa.array(counts, pa.int64())})


def mix_round(number: int) -> int:
    return int(mix(np.array([number], U))[0])


def _with_blocks(what, blocks: int):
    def run(table: pa.Table) -> pa.Table:
        return what(table, blocks)

    return run


def build_graph(nodes: DataFrame, count: int, rounds: int = ROUNDS, seed: int = 10) -> DataFrame:
    """Rows (node, v) to a table of graph blocks."""
    blocks = max(1, -(-count // BLOCK))
    placed = written(nodes.select("node", "v").mapInArrow(_unit(blocks), "block bigint, node bigint, vector binary"), "vectors")
    bits = max(0, (count // LEAF).bit_length() - 1)
    leaves = placed.mapInArrow(_leaf(TREES, bits, max(1, count // LEAF), seed), "tree bigint, leaf bigint, node bigint, vector binary")
    large = leaves.groupBy("tree", "leaf").count().where(F.col("count") > TASK_NODES)
    shares = large.select("tree", "leaf", F.ceil(F.col("count") / TASK_NODES).cast("bigint").alias("shares"))
    dealt = F.pmod(F.xxhash64("node", "tree"), F.coalesce("shares", F.lit(1).cast("bigint")))
    leaves = leaves.join(shares, ["tree", "leaf"], "left").withColumn("share", dealt).drop("shares")
    first = leaves.groupBy("tree", "leaf", "share").applyInArrow(_with_blocks(_start, blocks), PROPOSALS)
    graph = placed.groupBy("block").applyInArrow(_empty_lists, GRAPH)
    graph = written(graph.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(_take_over, GRAPH), "graph", "none")
    for number in range(rounds):
        edges = graph.mapInArrow(_edges(blocks), "block bigint, members binary, pivots binary, fresh binary")
        brought = edges.groupBy("block").cogroup(graph.groupBy("block")).applyInArrow(
            partial(_bring, blocks=blocks),
            "block bigint, members binary, vectors binary, limits binary, counts binary, pivots binary, fresh binary",
        )
        found = brought.groupBy("block").applyInArrow(_with_blocks(partial(_local_join, salt=mix_round(number)), blocks), PROPOSALS)
        graph = written(graph.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_take_over, GRAPH), "graph", "none")
        changed = scalar(graph.select("fresh").mapInArrow(_fresh_count, "n bigint").agg(F.sum("n")))[0] or 0
        if changed <= DONE * count * LIST:
            break
    return graph


STATE = "block bigint, queries binary, vectors binary, pool binary, sims binary, open binary"


def _pools(chosen: pa.Table, graph: pa.Table) -> pa.Table:
    """The queries of one block with their first pools: their own lists."""
    part = Part(graph)
    queries = np.unique(chosen.column("node").to_numpy())
    row = np.searchsorted(part.nodes, queries)
    pool, sims = np.full((len(queries), POOL), -1, np.int64), np.full((len(queries), POOL), FAR, np.float32)
    pool[:, :LIST], sims[:, :LIST] = part.lists[row][:, :POOL], part.sims[row][:, :POOL]
    values = (queries, part.vectors[row], pool, sims, pool >= 0)
    columns = [pa.array([part.block], pa.int64()), *[pa.array([_raw(x)], pa.binary()) for x in values]]
    return pa.table(columns, names=["block", "queries", "vectors", "pool", "sims", "open"])


class Pool:
    def __init__(self, table: pa.Table):
        get = lambda name, kind: np.frombuffer(table.column(name)[0].as_py(), kind)
        self.block = table.column("block")[0].as_py()
        self.queries = get("queries", np.int64)
        n = len(self.queries)
        self.vectors = get("vectors", np.float32).reshape(n, -1)
        self.pool = get("pool", np.int64).reshape(n, POOL).copy()
        self.sims = get("sims", np.float32).reshape(n, POOL).copy()
        self.open = get("open", np.bool_).reshape(n, POOL).copy()
        # The pool is sorted, nearest first: what is expanded next are the first open ones.
        self.next = self.open & (np.cumsum(self.open, axis=1) <= EXPAND)


ASKS = "block bigint, queries binary, vectors binary, limits binary, counts binary, ids binary"


def _asks(block_of: np.ndarray, query: np.ndarray, ids: np.ndarray, names: np.ndarray, vectors: np.ndarray, limits: np.ndarray) -> pa.Table:
    """Rows for each block: its queries (by row number ``query``) with their vectors, and the ids asked of it."""
    order = np.lexsort((ids, query, block_of))
    block_of, query, ids = block_of[order], query[order], ids[order]
    out: dict[str, list] = {"block": [], "queries": [], "vectors": [], "limits": [], "counts": [], "ids": []}
    cuts = np.flatnonzero(np.diff(block_of, prepend=-1, append=-1)).tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        rows, counts = np.unique(query[a:b], return_counts=True)
        out["block"].append(int(block_of[a]))
        for name, value in zip(list(out)[1:], (names[rows], vectors[rows], limits[rows], counts, ids[a:b]), strict=True):
            out[name].append(_raw(value))
    return pa.table([pa.array(v, pa.int64() if n == "block" else pa.binary()) for n, v in out.items()], names=list(out))


def _expand(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = Pool(pa.Table.from_batches([batch.slice(i, 1)]))
                rows, cols = np.nonzero(own.next)
                ids = own.pool[rows, cols]
                yield from _asks(_block(ids, blocks), rows, ids, own.queries, own.vectors, own.sims[:, -1]).to_batches()

    return run


def _asked(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Queries, vectors, limits, and (query row, id) of rows of asks; equal queries stay apart."""
    queries, limits, counts, ids = _flat(table, ("queries", "limits", "counts", "ids"), (np.int64, np.float32, np.int64, np.int64))
    vectors = np.frombuffer(b"".join(table.column("vectors").to_pylist()), np.float32).reshape(len(queries), -1)
    return queries, vectors, limits, np.repeat(np.arange(len(queries)), counts), ids


ADJACENT = "block bigint, nodes binary, counts binary, others binary"


def _adjacency(edges: pa.Table) -> pa.Table:
    """All neighbours of a block's nodes, both directions."""
    members, pivots = _flat(edges, ("members", "pivots"), (np.int64, np.int64))
    order = np.lexsort((pivots, members))
    members, pivots = members[order], pivots[order]
    new = np.ones(len(order), bool)
    new[1:] = (members[1:] != members[:-1]) | (pivots[1:] != pivots[:-1])
    nodes, counts = np.unique(members[new], return_counts=True)
    return pa.table(
        {"block": edges.column("block").slice(0, 1), **{n: pa.array([_raw(x)], pa.binary()) for n, x in (("nodes", nodes), ("counts", counts), ("others", pivots[new]))}}
    )


def _neighbours(asked: pa.Table, adjacent: pa.Table, blocks: int) -> pa.Table:
    queries, vectors, limits, who, ids = _asked(asked)
    nodes, counts, others = _flat(adjacent, ("nodes", "counts", "others"), (np.int64, np.int64, np.int64))
    begin = np.cumsum(counts) - counts
    at = np.searchsorted(nodes, ids)
    size = counts[at]
    spread = np.repeat(begin[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    who, found = np.repeat(who, size), others[spread]
    keep = found != queries[who]
    who, found = who[keep], found[keep]
    key = np.lexsort((found, who))
    new = np.ones(len(key), bool)
    new[1:] = (who[key][1:] != who[key][:-1]) | (found[key][1:] != found[key][:-1])
    who, found = who[key[new]], found[key[new]]
    return _asks(_block(found, blocks), who, found, queries, vectors, limits)


FOUND = "block bigint, queries binary, others binary, sims binary"


def _similar(asked: pa.Table, graph: pa.Table, blocks: int) -> pa.Table:
    """Asked nodes that are nearer than the end of the query's pool, for the query's block."""
    part = Part(graph)
    queries, vectors, limits, who, ids = _asked(asked)
    row = np.searchsorted(part.nodes, ids)
    sims = np.empty(len(ids), np.float32)
    for at in range(0, len(ids), 1 << 16):
        a, b = vectors[who[at : at + (1 << 16)]].astype(np.float32), part.vectors[row[at : at + (1 << 16)]].astype(np.float32)
        sims[at : at + (1 << 16)] = -np.einsum("ij,ij->i", a - b, a - b)
    near = sims > limits[who]
    names, others, sims = queries[who[near]], ids[near], sims[near]
    keep = _top(names, others, sims, POOL)
    names, others, sims = names[keep], others[keep], sims[keep]
    home = _block(names, blocks)
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.diff(home[order], prepend=-1, append=-1)).tolist()
    pairs = list(zip(cuts, cuts[1:], strict=False))
    cut = lambda x: pa.array([_raw(x[order][a:b]) for a, b in pairs], pa.binary())
    return pa.table(
        {"block": pa.array([int(home[order[a]]) for a, _ in pairs], pa.int64()), "queries": cut(names), "others": cut(others), "sims": cut(sims)}
    )


def _absorb(state: pa.Table, found: pa.Table) -> pa.Table:
    own = Pool(state)
    queries, others, sims = _flat(found, ("queries", "others", "sims"), (np.int64, np.int64, np.float32))
    own.open &= ~own.next
    rows, cols = np.nonzero(own.pool >= 0)
    owner = np.concatenate([rows, np.searchsorted(own.queries, queries)])
    other = np.concatenate([own.pool[rows, cols], others])
    sim = np.concatenate([own.sims[rows, cols], sims])
    known = np.concatenate([np.ones(len(rows), bool), np.zeros(len(others), bool)])
    open_ = np.concatenate([own.open[rows, cols], np.ones(len(others), bool)])
    order = np.lexsort((~known, other, owner))
    first = np.ones(len(order), bool)
    first[1:] = (owner[order][1:] != owner[order][:-1]) | (other[order][1:] != other[order][:-1])
    order = order[first]
    owner, other, sim, open_ = owner[order], other[order], sim[order], open_[order]
    keep = _top(owner, other, sim, POOL)
    owner, other, sim, open_ = owner[keep], other[keep], sim[keep], open_[keep]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    own.pool[:], own.sims[:], own.open[:] = -1, FAR, False
    own.pool[owner, place], own.sims[owner, place], own.open[owner, place] = other, sim, open_
    values = (own.queries, own.vectors, own.pool, own.sims, own.open)
    columns = [pa.array([own.block], pa.int64()), *[pa.array([_raw(x)], pa.binary()) for x in values]]
    return pa.table(columns, names=["block", "queries", "vectors", "pool", "sims", "open"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            own = Pool(pa.Table.from_batches([batch.slice(i, 1)]))
            rows, cols = np.nonzero(own.pool >= 0)
            yield pa.RecordBatch.from_pydict({"query": own.queries[rows], "node": own.pool[rows, cols]})


def search_graph(graph: DataFrame, queries: DataFrame, count: int) -> DataFrame:
    """Rows (node) of queries to rows (query, node): each query's pool after greedy search."""
    blocks = max(1, -(-count // BLOCK))
    edges = graph.mapInArrow(_edges(blocks), "block bigint, members binary, pivots binary, fresh binary")
    adjacent = written(edges.groupBy("block").applyInArrow(_adjacency, ADJACENT), "adjacent", "none")
    state = queries.groupBy("block").cogroup(graph.groupBy("block")).applyInArrow(_pools_or_none, STATE)
    state = written(state, "pools", "none")
    for _ in range(SEARCH_ROUNDS):
        asks = state.mapInArrow(_expand(blocks), ASKS)
        more = asks.groupBy("block").cogroup(adjacent.groupBy("block")).applyInArrow(partial(_if_asked, what=_neighbours, blocks=blocks, schema=ASKS), ASKS)
        found = more.groupBy("block").cogroup(graph.groupBy("block")).applyInArrow(partial(_if_asked, what=_similar, blocks=blocks, schema=FOUND), FOUND)
        state = written(state.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_absorb, STATE), "pools", "none")
        open_ = scalar(state.select("open").mapInArrow(_fresh_count, "n bigint").agg(F.sum("n")))[0] or 0
        if not open_:
            break
    return state.mapInArrow(_listed, "query bigint, node bigint")


def _empty(schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.table({n: pa.array([], kinds[k]) for n, k in fields})


def _pools_or_none(chosen: pa.Table, graph: pa.Table) -> pa.Table:
    return _pools(chosen, graph) if chosen.num_rows else _empty(STATE)


def _if_asked(asked: pa.Table, other: pa.Table, what, blocks: int, schema: str) -> pa.Table:
    return what(asked, other, blocks) if asked.num_rows and other.num_rows else _empty(schema)


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, vec_id, a, b) to (query_id, vec_id, score), in double precision."""
    for batch in batches:
        a, b = _vectors(batch.column(2)), _vectors(batch.column(3))
        score = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", "vec_id", "score"])


def nearest(table: DataFrame, every: int = 50, top: int = TOP, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score: the ``top`` nearest found for each row whose id ``every`` divides.

    A query's candidates are all rows but its own; ties go to the smaller id.  Of equal vectors only the
    ``top`` + 1 with the smallest ids can be among the nearest, so a node carries no more.
    """
    rows = written(usable(table, vec_id, vector), "rows")
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    members = rows.withColumn("place", place).where(F.col("place") <= top + 1)
    node = F.first("vec_id").over(Window.partitionBy("v").orderBy("vec_id"))
    members = written(members.withColumn("node", node), "members")
    nodes = members.where("place = 1").select("node", "v")
    count = nodes.count()
    graph = build_graph(nodes, count)
    blocks = max(1, -(-count // BLOCK))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("a"))
    nodes = nodes.select("node", F.col("v").alias("a"))
    queries = written(queries.join(nodes, "a"), "queries")
    asked = queries.select("node").distinct().mapInArrow(_homes(blocks), "block bigint, node bigint")
    found = search_graph(graph, asked, count)
    # A query's own node holds its copies.
    found = found.unionByName(asked.select(F.col("node").alias("query"), "node"))
    pairs = queries.join(found.withColumnRenamed("node", "other"), queries["node"] == F.col("query")).select("query_id", "a", "other")
    members = members.select(F.col("node").alias("other"), "vec_id", F.col("v").alias("b"))
    pairs = pairs.join(members, "other").where("vec_id <> query_id").select("query_id", "vec_id", "a", "b")
    scored = pairs.mapInArrow(_cosines, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _homes(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_block(batch.column(0).to_numpy(), blocks)), batch.column(0)], ["block", "node"])

    return run
