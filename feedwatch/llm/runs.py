"""Periodic runs of words, found online with catchers over completed blocks of 1, 2, 4, ... words.

At each level the text is cut into blocks of B = 2^k words.  A completed block is watched by a catcher while
the next 3B words arrive: each appended word ends one more suffix of B words, and the catcher compares it with
its block.  Equality says that the block recurs at a distance q, B <= q < 2B, and each such q belongs to one
level.  Two neighbouring blocks that recur at the same distance are a square of period q; squares that
continue each other merge into the run they lie in.  A stretch of four periods holds enough whole blocks for that,
so no run is missed.  Per appended word and level there is one comparison, of block names that are built
from the names of their halves, so a text of n words takes n log n of them, whatever it repeats.

Contracts: a run is a longest stretch with smallest period q, of ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods at
least.  Words are runs of characters other than the six ASCII blanks, compared by 64-bit hashes.  Null, empty and blank texts
have no runs and collapse to the empty text.  Rows are independent: repeated rows each get the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from feedwatch.llm.tables import col, fresh
from feedwatch.llm.words import mix, slices, text_buffer, word_hashes, word_spans

U = np.uint64
LEAST_WORDS = 6
LEAST_PERIODS = 4
SLICE_BYTES = 4 << 20  # of text whose words are appended to one catcher
PIECE = 1 << 16  # words appended at once
_LEFT, _RIGHT = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Level:
    """What catchers of one size need: names of the latest windows, hits and squares among them, and chains of squares."""

    def __init__(self) -> None:
        self.begin = 0  # first window kept
        self.names = np.zeros(0, U)
        self.hits = np.zeros(0, bool)
        self.squares = np.zeros(0, bool)
        self.opened: list[tuple[np.ndarray, np.ndarray]] = []  # (period, first word) of chains
        self.closed: list[tuple[np.ndarray, np.ndarray]] = []  # (period, end of the last block) of chains

    def add(self, names: np.ndarray) -> None:
        self.names = np.concatenate([self.names, names])
        self.hits = np.concatenate([self.hits, np.zeros(len(names), bool)])
        self.squares = np.concatenate([self.squares, np.zeros(len(names), bool)])

    def forget(self, before: int) -> None:
        if before - self.begin > PIECE:  # now and then, so that appending single words stays cheap
            cut = before - self.begin
            self.names, self.hits, self.squares = self.names[cut:], self.hits[cut:], self.squares[cut:]
            self.begin = before

    def chains(self, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Period, begin and end of every chain of blocks that recur at one distance; ``n`` words have come."""
        size = 1 << k
        last = np.arange(max(self.begin, n - 2 * size + 1, 0), n - size + 1)
        last = last[self.squares[last - self.begin]]
        block = ((last >> k) - 1) << k
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        period, begin = (np.concatenate(x) for x in zip(none, *self.opened, strict=True))
        order = np.lexsort((begin, period))
        ended, end = (np.concatenate(x) for x in zip(none, *self.closed, (last - block, block + size), strict=True))
        return period[order], begin[order], end[np.lexsort((end, ended))]


class SquareCatcher:
    """Takes words (64-bit numbers) as they come; ``append`` tells the new squares, ``runs`` what they merged into.

    ``longest`` bounds the length of a run, where the caller knows a bound: higher levels are then left out.
    """

    def __init__(self, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, longest: int | None = None):
        if least_periods < 4:
            raise ValueError("a stretch of under four periods may hold too few whole blocks")
        self.least_words, self.least_periods, self.longest = least_words, least_periods, longest
        self.words: list[np.ndarray] = []
        self.n = 0
        self.levels: list[_Level] = []

    def append(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and periods of the squares that the new words complete and that continue no earlier square."""
        words = np.asarray(words, U)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        found = [none, *[x for at in range(0, len(words), PIECE) for x in self._advance(words[at : at + PIECE])]]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _advance(self, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        old, self.n = self.n, self.n + len(words)
        self.words.append(words)
        found = []
        names = mix(words)
        k = 0
        while (size := 1 << k) <= self.n and (self.longest is None or self.least_periods * size <= self.longest):
            if k == len(self.levels):
                self.levels.append(_Level())
            level, first = self.levels[k], max(0, old - size + 1)
            if k:
                half, below = size // 2, self.levels[k - 1]
                lower = below.names[first - below.begin : self.n - size + 1 - below.begin]
                upper = below.names[first + half - below.begin : self.n - half + 1 - below.begin]
                names = mix(lower * _LEFT ^ upper * _RIGHT)
            level.add(names)
            # A suffix that begins at s is compared with the block that begins one to two sizes before it.
            s = np.arange(max(first, size), self.n - size + 1)
            block = ((s >> k) - 1) << k
            hit = level.names[s - level.begin] == level.names[block - level.begin]
            level.hits[s - level.begin] = hit
            # One size earlier the block before was compared at the same distance.
            square = hit & level.hits[s - size - level.begin] & (block >= size)
            level.squares[s - level.begin] = square
            before = level.squares[s - size - level.begin]
            opens, closes = np.flatnonzero(square & ~before), np.flatnonzero(before & ~square)
            if len(opens):
                level.opened.append(((s - block)[opens], block[opens] - size))
                found.append((block[opens] - size, (s - block)[opens]))
            if len(closes):
                level.closed.append(((s - block)[closes], block[closes]))
            k += 1
        for k, level in enumerate(self.levels):
            level.forget(self.n - (4 << k))
        return found

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and period of every run of the words so far, by start, then period."""
        words = np.concatenate(self.words) if self.words else np.zeros(0, U)
        self.words = [words]
        reach = np.zeros(self.n + 1, np.int64)  # the furthest end of a known run that begins here or before
        out = [np.zeros((3, 0), np.int64)]
        for k, level in enumerate(self.levels):
            size = 1 << k
            q, begin, end = level.chains(self.n, k)  # words begin ... end-1 recur q words later
            # What lies within a run of a shorter period is that run again, with a multiple of its period.
            new = (reach[begin] < end + q) & (end - begin >= (self.least_periods - 1) * q - 2 * size + 2)
            q, begin, end = q[new], begin[new], end[new]
            begin = begin - _equal(words, begin - 1, -1, q, size)
            end = end + _equal(words, end, 1, q, size)
            length = end - begin + q
            good = length >= np.maximum(self.least_words, self.least_periods * q)
            if good.any():
                out.append(np.stack([begin[good], length[good], q[good]]))
                np.maximum.at(reach, begin[good], (begin + length)[good])
                reach = np.maximum.accumulate(reach)
        start, length, period = np.concatenate(out, axis=1)
        order = np.lexsort((period, start))
        return start[order], length[order], period[order]


def _equal(words: np.ndarray, at: np.ndarray, step: int, period: np.ndarray, size: int) -> np.ndarray:
    """How many words from ``at`` on, in steps of 1 or -1 and fewer than ``size``, recur one period later."""
    out = np.zeros(len(at), np.int64)
    rows = max(1, (1 << 20) // size)
    for i in range(0, len(at), rows):
        place = at[i : i + rows, None] + step * np.arange(size)
        later = place + period[i : i + rows, None]
        inside = (place >= 0) & (later < len(words))
        same = inside & (words[np.where(inside, place, 0)] == words[np.where(inside, later, 0)])
        out[i : i + rows] = np.where(same.all(axis=1), size, same.argmin(axis=1))
    return out


def _found(texts: pa.Array, least_words: int, least_periods: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Runs of each text, the texts without what repeats, and how many words each has."""
    raw, at = text_buffer(texts)
    starts, ends, first = word_spans(raw, at)
    sizes = np.diff(first)
    longest = int(sizes.max()) if len(sizes) else 0
    catcher = SquareCatcher(least_words, least_periods, longest)
    # All texts of the slice are one sequence; a number of its own between two of them keeps them apart.
    owner = np.repeat(np.arange(len(sizes)), sizes)
    values = np.empty(len(starts) + len(sizes), U)
    values[np.arange(len(starts)) + owner] = word_hashes(raw, starts, ends)
    fences = first[1:] + np.arange(len(sizes))
    values[fences] = mix(np.arange(1, len(sizes) + 1, dtype=U) * _LEFT ^ _RIGHT)
    catcher.append(values)
    begin, length, period = catcher.runs()
    text = np.searchsorted(fences, begin)  # fences before: texts before
    begin = begin - text  # word numbers without the fences
    cuts = np.searchsorted(text, np.arange(len(sizes) + 1))
    runs = pa.StructArray.from_arrays([pa.array(begin - first[text]), pa.array(length), pa.array(period)], fields=list(_RUN))
    runs = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs)

    change = np.zeros(len(starts) + 1, np.int32)
    np.add.at(change, begin + period, 1)
    np.add.at(change, begin + length, -1)
    keep = np.cumsum(change[:-1]) == 0
    return runs, _joined(raw, at, starts[keep], ends[keep], owner[keep]), sizes


def _joined(raw: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> pa.Array:
    """The named words of each text, with one blank between two of them."""
    change = np.zeros(len(raw) + 2, np.int8)
    change[starts] += 1
    more = np.append(owner[1:] == owner[:-1], False) if len(owner) else np.zeros(0, bool)
    stops = ends + more  # a blank after each word but a text's last
    np.subtract.at(change, stops, 1)
    chosen = np.cumsum(change[: len(raw)], dtype=np.int8) > 0
    own = raw.copy()
    own[ends[more]] = 32
    offsets = np.concatenate([[0], np.cumsum(chosen)])[at]
    data = own[chosen]
    return pa.Array.from_buffers(
        pa.large_string(), len(at) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]
    ).cast(pa.string())


def find_runs(
    docs: DataFrame,
    text: str = "text",
    runs: str = "runs",
    collapsed: str = "collapsed",
    n_words: str = "n_words",
    least_words: int = LEAST_WORDS,
    least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """``docs`` with the runs of each whole text, the text without its repetitions and its number of words.

    ``runs`` is an array of (start, length, period) in words, by start, then period; ``collapsed`` holds the words
    that no run has after its first period, with one blank between them.  The three names are lengthened if taken.
    """
    names = docs.columns
    plain = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)], col(text).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "t", SLICE_BYTES):
                found, rest, sizes = _found(batch.column(len(names)), least_words, least_periods)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], found, rest, pa.array(sizes, pa.int64())],
                    [*batch.schema.names[:-1], "runs", "collapsed", "n_words"],
                )

    kinds = ", ".join(f"{c} {k}" for c, k in plain.dtypes[:-1])
    kinds += ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string, n_words bigint"
    found = plain.mapInArrow(run, kinds)
    taken = list(names)
    for name in (runs, collapsed, n_words):
        taken.append(fresh(name, taken))
    return found.toDF(*taken)
