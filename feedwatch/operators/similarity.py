"""Entries against target papers: title cosine, and mean of the top-k best sentence cosines.

Targets come from a configuration, entries are the big side.  No (target, entry) or sentence pair
ever becomes a row: each Arrow batch of entries is scored as matrix products against the targets of
its site, and only pairs that qualify are exploded.  Up to ``MAX_TARGET_BYTES`` of target vectors
(measured first) the targets are broadcast and entries are not shuffled at all; beyond that, blocks
of entries meet blocks of targets in a co-grouped shuffle with bounded groups and the same scores.
The kernels take a batch in parts of at most ``PAIRS_HELD`` pairs, so memory does not grow with the targets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedwatch.functions import text as tx
from feedwatch.functions.vectors import (
    encode_sentences,
    EncoderFactory,
    encode_in_batches,
    nested_offsets,
    nested_sizes,
    run_once,
)
from feedwatch.operators.joins import join_small
from feedwatch.session import durable, fresh_path

MAX_TARGET_BYTES = 64 << 20
ENCODER_BATCH = 256
LEADING = 4  # titles are bounded by a fourth of their dimensions
BOUND_SLACK = 1e-9  # far above rounding, far below any threshold's digits
PAIRS_AT_ONCE = 1 << 14
PAIRS_HELD = 1 << 17  # pairs (with ``best_sentences``: their target sentences) that a kernel holds at once
CELLS_HELD = 1 << 18  # sentence cosines of one target
BLOCK_ENTRIES = BLOCK_TARGETS = 1024  # rows of a block, on average
HIT = "array<struct<target_pos:int,title_similarity:double>>"
SCORED = "array<struct<target_pos:int,title_similarity:double,top_k_score:double>>"
BEST = "array<struct<target_pos:int,i:int,j:int,similarity:double>>"
RANKED = "array<struct<target_pos:int,i:int,j:int,similarity:double,rank:int>>"


@dataclass(frozen=True)
class Settings:
    num_similar_sentences: int = 4
    title_threshold: float = 0.82
    sentence_threshold: float = 0.82
    use_and: bool = True


# ---------------------------------------------------------------- matrices from Arrow columns

# (column) -> (row boundaries, vectors of all rows below one another)
Reader = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def _matrix(vectors: pa.Array) -> np.ndarray:
    if len(vectors) == 0:
        return np.zeros((0, 0))
    if vectors.null_count:
        raise ValueError("a vector is missing")
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def read_vector_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return nested_offsets(column), _matrix(column.flatten())


def read_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.arange(len(column) + 1), _matrix(column)


def text_list_reader(factory: EncoderFactory) -> Reader:
    """Sentences are encoded where they are scored, so vectors never cross a process boundary."""
    encode = factory()

    def read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return nested_offsets(column), encode_in_batches(encode, column.flatten(), ENCODER_BATCH)

    return read


def text_reader(factory: EncoderFactory) -> Reader:
    encode = factory()

    def read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(column) + 1), encode_in_batches(encode, column, ENCODER_BATCH)

    return read


# ---------------------------------------------------------------- targets


class SiteTargets:
    """The targets of one site as matrices, addressed by ``target_pos``."""

    def __init__(self, positions: np.ndarray, titles: np.ndarray, sentences: list[np.ndarray]) -> None:
        self.positions = positions
        self.titles, self.title_norms = titles, _norms(titles)
        unit = _unit(titles, self.title_norms)
        # The directions that hold most of the titles, leading ones first.
        self.basis = np.linalg.svd(unit, full_matrices=False)[2][: max(1, titles.shape[1] // LEADING)].T if titles.size else titles.T
        self.lead, self.rest = _split(unit, self.basis)
        self.sentences = {
            int(p): (m, _norms(m)) for p, m in zip(positions, sentences, strict=True)
        }


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix * matrix).sum(axis=1)) if len(matrix) else np.zeros(0)


def _unit(matrix: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return np.divide(matrix, norms[:, None], out=np.zeros_like(matrix, dtype=float), where=norms[:, None] > 0)


def _split(unit: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates in the basis, and the length of what lies outside of it."""
    lead = unit @ basis
    outside = (unit * unit).sum(axis=1) - (lead * lead).sum(axis=1)
    return lead, np.sqrt(np.maximum(outside, 0))


def screen_titles(known: SiteTargets, block: np.ndarray, least: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, targets and cosines of the pairs over ``least`` (None: of all), and how many cosines each row took.

    A cosine is at most the product within the leading directions plus the product of the lengths outside (Cauchy and
    Schwarz), so pairs whose bound is not over ``least`` are left out unseen.  The bound takes a product of a ``LEADING``-th
    of the columns; where it leaves more than half of the pairs, the whole product is taken instead.
    """
    norms = _norms(block)
    if least is not None and len(block) and len(known.positions):
        lead, rest = _split(_unit(block, norms), known.basis)
        row, target = np.nonzero(lead @ known.lead.T + np.outer(rest, known.rest) > least - BOUND_SLACK)
        if 2 * len(row) <= len(block) * len(known.positions):
            sims = np.zeros(len(row))
            for at in range(0, len(row), PAIRS_AT_ONCE):
                i, j = row[at : at + PAIRS_AT_ONCE], target[at : at + PAIRS_AT_ONCE]
                scale = norms[i] * known.title_norms[j]
                dots = np.einsum("ij,ij->i", block[i], known.titles[j])
                sims[at : at + PAIRS_AT_ONCE] = np.divide(dots, scale, out=np.zeros(len(i)), where=scale > 0)
            sims = np.round(sims, 12)
            keep = sims > least
            return row[keep], target[keep], sims[keep], np.bincount(row, minlength=len(block))
    sims = _cosines(block, norms, known.titles, known.title_norms)
    row, target = np.nonzero(np.ones_like(sims, dtype=bool) if least is None else sims > least)
    return row, target, sims[row, target], np.full(len(block), len(known.positions))


def _cosines(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """All cosines of two blocks; zero vectors give 0.

    Rounded far below single precision: the last bits of a matrix product depend on the block's
    shape, and ties must rank the same however the rows were batched.
    """
    scale = np.outer(na, nb)
    cosines = np.divide(a @ b.T, scale, out=np.zeros_like(scale), where=scale > 0)
    return np.round(cosines, 12)


def target_bytes(targets: DataFrame) -> int:
    """Size of all target vectors, from array sizes only."""
    doubles = F.size("title_vec") + F.aggregate(
        F.col("sent_vecs"), F.lit(0), lambda acc, v: acc + F.size(v)
    )
    return 8 * (targets.agg(F.sum(doubles.cast("bigint"))).first()[0] or 0)


def _book(targets: pa.Table) -> dict[str, SiteTargets]:
    """Targets by site, straight from Arrow buffers."""
    columns = [_one_chunk(targets, n) for n in ("target_pos", "title_vec", "sent_vecs")]
    positions = columns[0].to_numpy(zero_copy_only=False)
    titles = _matrix(columns[1])
    offsets, vectors = read_vector_lists(columns[2])
    book = {}
    for site, rows in _site_rows(_one_chunk(targets, "site")):
        rows = rows[np.argsort(positions[rows])]
        sentences = [vectors[offsets[r] : offsets[r + 1]] for r in rows]
        book[site] = SiteTargets(positions[rows], titles[rows], sentences)
    return book


# ---------------------------------------------------------------- kernels (one Arrow batch each)


def _site_rows(sites: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    coded = sites.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    for code, site in enumerate(coded.dictionary.to_pylist()):
        yield site, np.flatnonzero(codes == code)


def _parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Neighbouring rows whose sizes add up to ``most`` at most (a larger row stands alone); one empty part for no rows."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes) or not at:
        before = ends[at - 1] if at else 0
        end = min(len(sizes), max(at + 1, int(np.searchsorted(ends, before + most, side="right"))))
        yield slice(at, end)
        at = max(end, 1)


def _in_part(array: pa.Array, part: slice) -> pa.Array:
    return array.slice(part.start, part.stop - part.start)


def _sentences_in_part(offsets: np.ndarray, vectors: np.ndarray, part: slice) -> tuple[np.ndarray, np.ndarray]:
    own = offsets[part.start : part.stop + 1]
    return own - own[0], vectors[own[0] : own[-1]]


def _targets_of(book, sites: pa.Array, size: Callable[[SiteTargets], int]) -> np.ndarray:
    """A number of the targets of each row's site."""
    sizes = np.zeros(len(sites), np.int64)
    for site, rows in _site_rows(sites):
        if site in book:
            sizes[rows] = size(book[site])
    return sizes


def _list_array(rows: list[np.ndarray], n: int, fields: dict[str, tuple[np.ndarray, pa.DataType]]) -> pa.Array:
    """List-of-struct column; ``rows`` holds the owning row of every element, in row order."""
    counts = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    struct = pa.StructArray.from_arrays(
        [pa.array(v, t, from_pandas=True) for v, t in fields.values()], names=list(fields)
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)


def _by_row(parts: list[tuple[np.ndarray, ...]], width: int) -> list[np.ndarray]:
    """Column-wise concatenation of kernel pieces, ordered by row and then target position."""
    if not parts:
        return [np.zeros(0, dtype=np.int64) for _ in range(width)]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    order = np.lexsort((columns[1], columns[0]))
    return [c[order] for c in columns]


def _title_hits(book, sites: pa.Array, titles: np.ndarray, least: float | None) -> pa.Array:
    parts = []
    for site, rows in _site_rows(sites):
        known = book.get(site)
        if known is None:
            continue
        row, target, sims, _ = screen_titles(known, titles[rows], least)
        parts.append((rows[row], known.positions[target], sims))
    rows, targets, sims = _by_row(parts, 3)
    return _list_array(
        rows,
        len(sites),
        {"target_pos": (targets, pa.int32()), "title_similarity": (sims, pa.float64())},
    )


def _title_hits_in_parts(book, sites: pa.Array, titles: np.ndarray, least: float | None) -> Iterator[pa.Array]:
    """``_title_hits`` of neighbouring rows, which share out the pairs that are held at once."""
    for part in _parts(_targets_of(book, sites, lambda known: len(known.positions)), PAIRS_HELD):
        yield _title_hits(book, _in_part(sites, part), titles[part], least)


def _qualified_in_parts(book, sites, titles, offsets, vectors, settings: Settings, least: float | None) -> Iterator[pa.Array]:
    """Lists of the scored targets that qualify, for neighbouring rows at a time."""
    for part in _parts(_targets_of(book, sites, lambda known: len(known.positions)), PAIRS_HELD):
        own = _in_part(sites, part)
        hits = _title_hits(book, own, titles[part], least)
        scored = _sentence_scores(book, own, hits, *_sentences_in_part(offsets, vectors, part), settings.num_similar_sentences)
        yield _only_similar(scored, settings)


def _candidates(book, sites: pa.Array, hits: pa.Array):
    """Yields (target matrix, norms, target position, rows, title cosines), one target at a time."""
    owner = np.repeat(np.arange(len(hits)), nested_sizes(hits))
    flat = hits.flatten()
    position = flat.field("target_pos").to_numpy(zero_copy_only=False)
    title = flat.field("title_similarity").to_numpy(zero_copy_only=False)
    coded = sites.dictionary_encode()
    site_of = coded.indices.to_numpy(zero_copy_only=False)[owner]
    names = coded.dictionary.to_pylist()
    order = np.lexsort((owner, position, site_of))
    changes = np.diff(site_of[order]).astype(bool) | np.diff(position[order]).astype(bool)
    for chosen in np.split(order, np.flatnonzero(changes) + 1):
        if len(chosen):
            p = int(position[chosen[0]])
            matrix, norms = book[names[site_of[chosen[0]]]].sentences[p]
            yield matrix, norms, p, owner[chosen], title[chosen]


def _gather(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the sentences of ``rows`` and the start of each row in the gathered block."""
    sizes = offsets[rows + 1] - offsets[rows]
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return np.repeat(offsets[rows] - starts, sizes) + np.arange(sizes.sum()), starts


def _blocks_of_sentences(matrix, target_norms, rows, offsets, vectors, norms):
    """Yields (which of ``rows``, cosines with their sentences, start of each row): rows with sentences, bounded cells at once."""
    filled = np.flatnonzero(offsets[rows + 1] > offsets[rows])
    if not len(matrix) or not len(filled):
        return
    sizes = offsets[rows[filled] + 1] - offsets[rows[filled]]
    for part in _parts(sizes * len(matrix), CELLS_HELD):
        index, starts = _gather(offsets, rows[filled[part]])
        yield filled[part], _cosines(matrix, target_norms, vectors[index], norms[index]), starts


def _sentence_scores(book, sites, hits, offsets, vectors, num_similar: int) -> pa.Array:
    norms = _norms(vectors)
    parts = []
    for matrix, target_norms, p, rows, title in _candidates(book, sites, hits):
        scores = np.full(len(rows), np.nan)
        for which, sims, starts in _blocks_of_sentences(matrix, target_norms, rows, offsets, vectors, norms):
            best = np.maximum.reduceat(sims, starts, axis=1)
            totals = np.cumsum(-np.sort(-best, axis=0), axis=0)
            sizes = offsets[rows[which] + 1] - offsets[rows[which]]
            k = np.minimum(num_similar, np.minimum(sizes, len(matrix)))
            scores[which] = totals[k - 1, np.arange(len(which))] / k
        parts.append((rows, np.full(len(rows), p), title, scores))
    rows, targets, title, scores = _by_row(parts, 4)
    return _list_array(
        rows,
        len(sites),
        {
            "target_pos": (targets, pa.int32()),
            "title_similarity": (title, pa.float64()),
            "top_k_score": (scores, pa.float64()),
        },
    )


def _best_sentences(book, sites, hits, offsets, vectors, most: int | None = None) -> pa.Array:
    """``most``: only so many of each pair, ranked; ties stay in target-sentence order."""
    norms = _norms(vectors)
    parts = []
    for matrix, target_norms, p, rows, _ in _candidates(book, sites, hits):
        for which, sims, starts in _blocks_of_sentences(matrix, target_norms, rows, offsets, vectors, norms):
            sizes = np.diff(np.append(starts, sims.shape[1]))
            top = np.maximum.reduceat(sims, starts, axis=1)
            place = np.arange(sims.shape[1]) - np.repeat(starts, sizes)
            # the first of a row's sentences that has the highest cosine (or none that is a number)
            first = (sims == np.repeat(top, sizes, axis=1)) | np.isnan(sims)
            best = np.minimum.reduceat(np.where(first, place, sims.shape[1]), starts, axis=1)
            i = np.tile(np.arange(len(matrix))[:, None], len(which))
            if most is not None:
                i = np.argsort(-top, axis=0, kind="stable")[:most]
                top, best = np.take_along_axis(top, i, axis=0), np.take_along_axis(best, i, axis=0)
            n = len(i)
            owner = np.repeat(rows[which], n)
            parts.append((owner, np.full(len(owner), p), i.T.ravel(), best.T.ravel(), top.T.ravel(), np.tile(np.arange(1, n + 1), len(which))))
    rows, targets, i, j, sims, rank = _by_row(parts, 6)
    fields = {
        "target_pos": (targets, pa.int32()),
        "i": (i, pa.int32()),
        "j": (j, pa.int32()),
        "similarity": (sims, pa.float64()),
    }
    if most is not None:
        fields["rank"] = (rank, pa.int32())
    return _list_array(rows, len(sites), fields)


def _sentences_of_hits(book, sites: pa.Array, hits: pa.Array, most: int | None) -> np.ndarray:
    """For each row, how many sentences the targets of its hits have (of each at most ``most``), but one a hit at least."""
    owner, flat = np.repeat(np.arange(len(hits)), nested_sizes(hits)), hits.flatten()
    position, counts = flat.field("target_pos").to_numpy(zero_copy_only=False), np.ones(len(flat), np.int64)
    for site, rows in _site_rows(sites):
        own = np.isin(owner, rows)
        if own.any():
            known = book[site]
            lengths = np.array([len(known.sentences[int(p)][0]) for p in known.positions])
            counts[own] = lengths[np.searchsorted(known.positions, position[own])]
    counts = np.maximum(counts if most is None else np.minimum(counts, most), 1)
    return np.bincount(owner, counts, minlength=len(hits)).astype(np.int64)


# ---------------------------------------------------------------- predicates


def above(value: Column | str, threshold: float) -> Column:
    """Strictly above; missing and NaN are not (Spark orders NaN above every number)."""
    value = tx.as_col(value)
    return F.coalesce(F.when(F.isnan(value), False).otherwise(value > threshold), F.lit(False))


def is_similar_paper(title: Column, score: Column, settings: Settings) -> Column:
    by_title = above(title, settings.title_threshold)
    by_sentences = above(score, settings.sentence_threshold)
    return by_title & by_sentences if settings.use_and else by_title | by_sentences


# ---------------------------------------------------------------- operators


def broadcast_targets(targets: DataFrame, max_bytes: int = MAX_TARGET_BYTES):
    """Broadcast target matrices by site, or None when they are over the bound."""
    if target_bytes(targets) > max_bytes:
        return None
    table = targets.select("site", "target_pos", "title_vec", "sent_vecs").toArrow()
    return targets.sparkSession.sparkContext.broadcast(_book(table))


def over_books(
    entries: DataFrame, targets: DataFrame, run: Callable[[DataFrame, object], DataFrame], max_bytes: int = MAX_TARGET_BYTES
) -> DataFrame:
    """``run(entries, book)`` for all targets: one book within the bound, else the union over books of targets.

    Each book is broadcast, its rows are stored, and it is freed.  ``run`` has to treat pairs of an entry and a target
    on their own; an entry with hits in several books has a row for each.
    """
    book = broadcast_targets(targets, max_bytes)
    if book is not None:
        return run(entries, book)
    known = durable(targets.select("site", "target_pos", "title_vec", "sent_vecs"), "targets")
    books = max(1, min(known.count(), -(-2 * target_bytes(known) // max(max_bytes, 1))))
    path = fresh_path(entries.sparkSession, "books")
    for number in range(books):
        own = known.where(F.pmod(F.xxhash64("site", "target_pos"), F.lit(books)) == number)
        book = entries.sparkSession.sparkContext.broadcast(_book(own.toArrow()))
        rows = run(entries, book)
        rows.write.mode("append").parquet(path)
        book.destroy()
    return entries.sparkSession.read.schema(rows.schema).parquet(path)


def title_hits(
    entries: DataFrame,
    book,
    least: float | None,
    title: str = "title_vec",
    encoder: EncoderFactory | None = None,
) -> DataFrame:
    """Adds ``hits``: targets of the entry's site whose title cosine exceeds ``least``.

    Entries without a hit are dropped; ``least=None`` keeps every target of the site.
    """
    return title_hits_or_none(entries, book, least, title, encoder).where(F.size("hits") > 0)


def title_hits_or_none(
    entries: DataFrame, book, least: float | None, title: str = "title_vec", encoder: EncoderFactory | None = None
) -> DataFrame:
    """As ``title_hits``, with empty lists for entries without a hit."""

    @F.arrow_udf(HIT)
    def hits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        read = read_vectors if encoder is None else text_reader(encoder)
        for sites, titles in batches:
            yield from _title_hits_in_parts(book.value, sites, read(titles)[1], least)

    return entries.withColumn("hits", run_once(hits)("site", title))


def title_cosines(
    entries: DataFrame, book, least: float | None, title: str = "title_vec", encoder: EncoderFactory | None = None
) -> DataFrame:
    """Adds ``n_cosines``: how many cosines with targets of its site the screening computes for an entry."""

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        read = read_vectors if encoder is None else text_reader(encoder)
        for sites, titles in batches:
            vectors, counts = read(titles)[1], np.zeros(len(sites), np.int64)
            for site, rows in _site_rows(sites):
                if site in book.value:
                    counts[rows] = screen_titles(book.value[site], vectors[rows], least)[3]
            yield pa.array(counts)

    return entries.withColumn("n_cosines", run_once(counted)("site", title))


def sentence_scores(
    candidates: DataFrame,
    book,
    num_similar: int,
    sentences: str = "sent_vecs",
    encoder: EncoderFactory | None = None,
) -> DataFrame:
    """Adds ``scored``: the hits with the mean of their top-k best sentence cosines."""

    @F.arrow_udf(SCORED)
    def scored(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        read = read_vector_lists if encoder is None else text_list_reader(encoder)
        for sites, hits, column in batches:
            offsets, vectors = read(column)
            for part in _parts(nested_sizes(hits), PAIRS_HELD):
                own = _sentences_in_part(offsets, vectors, part)
                yield _sentence_scores(book.value, _in_part(sites, part), _in_part(hits, part), *own, num_similar)

    return candidates.withColumn("scored", run_once(scored)("site", "hits", sentences))


def best_sentences(
    candidates: DataFrame,
    book,
    sentences: str = "sent_vecs",
    encoder: EncoderFactory | None = None,
    most: int | None = None,
) -> DataFrame:
    """One row per target sentence ``i`` of every hit: its best entry sentence ``j`` (lowest on ties).

    ``most``: only the best so many of each pair, with their ``rank``; nothing is shuffled for it.
    """

    @F.arrow_udf(BEST if most is None else RANKED)
    def best(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        read = read_vector_lists if encoder is None else text_list_reader(encoder)
        for sites, hits, column in batches:
            offsets, vectors = read(column)
            for part in _parts(_sentences_of_hits(book.value, sites, hits, most), PAIRS_HELD):
                own = _sentences_in_part(offsets, vectors, part)
                yield _best_sentences(book.value, _in_part(sites, part), _in_part(hits, part), *own, most)

    rows = candidates.withColumn("best", F.explode(run_once(best)("site", "hits", sentences)))
    return rows.select(*candidates.columns, "best.*")


def similar_pairs(
    entries: DataFrame,
    targets: DataFrame,
    settings: Settings,
    encoder: EncoderFactory | None = None,
    title: str = "title_vec",
    sentences: str = "sent_vecs",
    prune: bool = True,
    max_bytes: int = MAX_TARGET_BYTES,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    spread: int | None = None,
) -> DataFrame:
    """Qualifying (entry, target) pairs: the entry's columns, ``target_pos`` and both scores.

    With ``use_and`` only pairs whose title qualifies go on to the sentences, with equal results.
    ``prepare`` derives the sentence column after that cut, so costly text work is done for
    survivors only; ``spread`` deals what the sentences are scored of out over that many tasks first.
    ``entries`` needs ``site`` and ``pos``.
    """
    dealt = lambda rows: rows.repartition(spread) if spread else rows
    ready = lambda rows: dealt(rows) if prepare is None else prepare(dealt(rows))
    book = broadcast_targets(targets, max_bytes)
    if book is None:
        least = settings.title_threshold if settings.use_and and prune else None
        return _pairs_by_blocks(entries, targets, settings, encoder, title, sentences, ready, least)
    if not (settings.use_and and prune):
        scored = qualified(ready(entries), book, settings, encoder, title, sentences)
        return scored.withColumn("pair", F.explode("scored")).select(*entries.columns, "pair.*")
    candidates = title_hits(entries, book, settings.title_threshold, title, encoder)
    scored = sentence_scores(
        ready(candidates), book, settings.num_similar_sentences, sentences, encoder
    )
    return explode_pairs(scored, entries.columns, settings)


def explode_pairs(scored: DataFrame, keep: list[str], settings: Settings) -> DataFrame:
    """Only qualifying pairs become rows."""
    similar = F.filter(
        F.col("scored"),
        lambda s: is_similar_paper(s["title_similarity"], s["top_k_score"], settings),
    )
    return scored.withColumn("pair", F.explode(similar)).select(*keep, "pair.*")


def qualified(
    entries: DataFrame, book, settings: Settings, encoder: EncoderFactory | None, title: str, sentences: str
) -> DataFrame:
    """Adds ``scored``: only the targets that qualify, found in one pass over titles and sentences.

    Where titles do not screen (under OR), every target of a site is scored, but in the kernel only.
    """

    @F.arrow_udf(SCORED)
    def scored(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        read_title = read_vectors if encoder is None else text_reader(encoder)
        read_sents = read_vector_lists if encoder is None else text_list_reader(encoder)
        for sites, titles, column in batches:
            yield from _qualified_in_parts(book.value, sites, read_title(titles)[1], *read_sents(column), settings, None)

    return entries.withColumn("scored", run_once(scored)("site", title, sentences))


def _only_similar(scored: pa.Array, settings: Settings) -> pa.Array:
    """Lists of scored targets without those that do not qualify."""
    flat, offsets = scored.flatten(), scored.offsets.to_numpy()
    title, score = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("title_similarity", "top_k_score"))
    by_title, by_score = title > settings.title_threshold, score > settings.sentence_threshold  # NaN is not above
    kept = by_title & by_score if settings.use_and else by_title | by_score
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets - offsets[0]]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(kept)))


def _pairs_by_blocks(
    entries: DataFrame,
    targets: DataFrame,
    settings: Settings,
    encoder: EncoderFactory | None,
    title: str,
    sentences: str,
    ready: Callable[[DataFrame], DataFrame],
    least: float | None,
) -> DataFrame:
    """The way for more targets than can be broadcast: blocks of entries meet blocks of their site's targets.

    Titles are encoded once, into a stored table.  With ``least`` titles meet alone first, and only entries with a hit go
    on: their summaries are made ready and encoded once, and meet the targets' sentences.  Texts of entries are never copied.
    """
    known = durable(targets.select("site", "target_pos", "title_vec", "sent_vecs"), "targets")
    keyed = entries.withColumn("_entry", F.monotonically_increasing_id())
    if encoder is not None:
        keyed = keyed.withColumn("_title_vec", F.get(encode_sentences(F.array(title), encoder), 0))
        title = "_title_vec"
    keyed = durable(keyed, "titles")
    blocks = durable(_blocks(keyed, known), "blocks")
    if least is not None:

        def near(rows: pa.Table, book) -> pa.Table:
            hits = _title_hits_in_parts(book, _one_chunk(rows, "site"), _matrix(_one_chunk(rows, title)), least)
            found = np.concatenate([nested_sizes(part) > 0 for part in hits])
            return pa.table({"_entry": rows.column("_entry").filter(pa.array(found))})

        none = F.array().cast("array<array<double>>")
        hits = _meet(keyed.select("_entry", "site", title), known.withColumn("sent_vecs", none), blocks, near, "_entry bigint")
        keyed = keyed.join(hits, "_entry", "left_semi")
    held = ready(keyed)
    if encoder is not None:
        held = held.withColumn("_sent_vecs", encode_sentences(F.col(sentences), encoder))
        sentences = "_sent_vecs"
    names = [c for c in held.columns if c not in ("_entry", "_title_vec", "_sent_vecs")]
    held = durable(held, "sentences")

    def score(rows: pa.Table, book) -> pa.Table:
        sites, titles = _one_chunk(rows, "site"), _matrix(_one_chunk(rows, title))
        offsets, vectors = read_vector_lists(_one_chunk(rows, sentences))
        parts = list(_qualified_in_parts(book, sites, titles, offsets, vectors, settings, least))
        owner = np.repeat(np.arange(len(sites)), np.concatenate([nested_sizes(part) for part in parts]))
        flat = pa.concat_arrays([part.flatten() for part in parts])
        return pa.table({"_entry": rows.column("_entry").take(pa.array(owner)), **{f.name: flat.field(f.name) for f in flat.type}})

    kinds = "_entry bigint, target_pos int, title_similarity double, top_k_score double"
    pairs = _meet(held.select("_entry", "site", title, sentences), known, blocks, score, kinds)
    return held.join(pairs, "_entry").select(*names, *(c for c in pairs.columns if c != "_entry"))


def _blocks(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """For each site of both sides, into how many blocks its entries and its targets are dealt."""
    number = lambda most, name: F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name)
    rows = keyed.groupBy("site").agg(number(BLOCK_ENTRIES, "_rows"))
    return rows.join(known.groupBy("site").agg(number(BLOCK_TARGETS, "_targets")), "site")


def _meet(
    rows: DataFrame, known: DataFrame, blocks: DataFrame, run: Callable[[pa.Table, object], pa.Table], kinds: str
) -> DataFrame:
    """``run`` on each block of entries with each block of their site's targets: one shuffle, and groups of bounded rows."""
    place = lambda number, *of: F.pmod(F.xxhash64(*of), F.col(number)).cast("int")
    every = lambda number: F.explode(F.sequence(F.lit(0), F.col(number) - 1))
    dealt = ["_rows", "_targets"]
    left = join_small(rows, blocks, "site", "_entry").withColumns({"_b": place("_rows", "_entry"), "_t": every("_targets")}).drop(*dealt)
    right = join_small(known, blocks, "site", "target_pos")
    right = right.withColumns({"_t": place("_targets", "site", "target_pos"), "_b": every("_rows")}).drop(*dealt)

    def met(own: pa.Table, other: pa.Table) -> pa.Table:
        return run(own, _book(other if own.num_rows else other.slice(0, 0)))

    keys = ["site", "_b", "_t"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, kinds)


def _one_chunk(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    if column.num_chunks == 1:
        return column.chunk(0)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def pairs_compared(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Compared pairs per site, as a product of counts and not by forming the pairs."""
    n_entries = entries.groupBy("site").agg(F.count("*").alias("n_entries"))
    n_targets = targets.groupBy("site").agg(F.count("*").alias("n_targets"))
    return n_entries.join(n_targets, "site").select(
        "site",
        "n_entries",
        "n_targets",
        (F.col("n_entries") * F.col("n_targets")).alias("n_pairs"),
    )


# ---------------------------------------------------------------- long form, for reports


def rank_sentence_matches(best: DataFrame, keys: list[str]) -> DataFrame:
    """Rank the best matches of a pair; ties stay in target-sentence order (a stable sort).

    A window holds the sentences of one target paper, so its size does not grow with the feed.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("similarity"), F.asc("i"))
    return best.withColumn("rank", F.row_number().over(order))


def dynamic_top_k(ranked: DataFrame, num_similar: int) -> DataFrame:
    """First min(num_similar, entry sentences, target sentences) ranks of every pair."""
    cap = F.least(F.lit(num_similar), F.col("n_entry_sentences"), F.col("n_target_sentences"))
    return ranked.where(F.col("rank") <= cap)


def top_k_score(kept: DataFrame, keys: list[str]) -> DataFrame:
    return kept.groupBy(*keys).agg(F.avg("similarity").alias("top_k_score"))


def top_k_score_fixed(ranked: DataFrame, keys: list[str], num_similar: int) -> DataFrame:
    """Evaluation variant: sum of up to ``num_similar`` scores over the constant ``num_similar``."""
    kept = ranked.where(F.col("rank") <= num_similar)
    return kept.groupBy(*keys).agg((F.sum("similarity") / num_similar).alias("top_k_score"))


# ---------------------------------------------------------------- triplets


def _pair_score(a: np.ndarray, b: np.ndarray, num_similar: int) -> float:
    if not len(a) or not len(b):
        return 0.0
    best = _cosines(a, _norms(a), b, _norms(b)).max(axis=1)
    return float(np.sort(best)[::-1][:num_similar].sum()) / num_similar


def triplet_scores(triplets: DataFrame, num_similar: int = 4) -> DataFrame:
    """Rows with title and sentence vectors of anchor, positive and negative → four scores.

    A triplet is one row, so this is a map: nothing is shuffled and batches stay bounded.
    """
    result = "struct<title_positive:double,title_negative:double,score_positive:double,score_negative:double>"
    roles = ("anchor", "positive", "negative")

    @F.arrow_udf(result)
    def scores(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            titles = [read_vectors(c)[1] for c in columns[:3]]
            sents = [read_vector_lists(c) for c in columns[3:]]

            def rows_of(which: int, row: int, held=sents) -> np.ndarray:
                offsets, matrix = held[which]
                return matrix[offsets[row] : offsets[row + 1]]

            out = []
            for row in range(len(columns[0])):
                a = titles[0][row : row + 1]
                out.append(
                    [float(_cosines(a, _norms(a), t, _norms(t))[0, 0])
                     for t in (titles[1][row : row + 1], titles[2][row : row + 1])]
                    + [_pair_score(rows_of(0, row), rows_of(w, row), num_similar) for w in (1, 2)]
                )
            flat = np.asarray(out, dtype=np.float64).reshape(-1, 4)
            yield pa.StructArray.from_arrays(
                [pa.array(flat[:, c]) for c in range(4)],
                names=["title_positive", "title_negative", "score_positive", "score_negative"],
            )

    arguments = [f"{r}_title_vec" for r in roles] + [f"{r}_sent_vecs" for r in roles]
    rest = [c for c in triplets.columns if c not in arguments]
    scored = triplets.withColumn("s", run_once(scores)(*arguments)).select(*rest, "s.*")
    return scored.withColumn("margin", F.col("score_positive") - F.col("score_negative"))


def triplet_accuracy(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("n_triplets"),
        F.avg((F.col("margin") > 0).cast("double")).alias("accuracy"),
        F.avg("margin").alias("mean_margin"),
    )
