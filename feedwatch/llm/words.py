"""Words, their hashes and hashes of word windows, for whole Arrow batches at once with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_M1, _M2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_STEP = U(0x9E3779B97F4A7C15)
_LONG = 256  # words above this many bytes are hashed one by one

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * _M1
    x = x ^ (x >> U(33))
    x = x * _M2
    return x ^ (x >> U(33))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array in one piece, and where each text starts (nulls are empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word's number for each text (and the total)."""
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    blank = _SPACE[raw]
    begins, ends = ~blank, ~blank
    fresh_text = np.zeros(len(raw) + 1, bool)
    fresh_text[at] = True
    begins[1:] &= blank[:-1] | fresh_text[1:-1]
    ends[:-1] &= blank[1:] | fresh_text[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes of all words at a time."""
    lengths = ends - starts
    out = mix(lengths.astype(U) * _STEP)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    todo = np.flatnonzero((lengths > 0) & (lengths <= _LONG))
    lane = 0
    while len(todo):
        left = lengths[todo] - 8 * lane
        value = lanes[starts[todo] + 8 * lane]
        short = np.minimum(left, 8).astype(U)
        value = value & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * short))
        out[todo] = mix(out[todo] * _STEP ^ value)
        todo = todo[left > 8]
        lane += 1
    for i in np.flatnonzero(lengths > _LONG):
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return out


def window_hashes(values: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``width`` values (the run that starts at each place), by prefix sums."""
    n = len(values)
    if n < width:
        return np.zeros(0, U)
    factor = (0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64 | 1
    powers = np.full(n, factor, U)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(values ^ U(seed)) * powers, dtype=U)])
    back = np.full(n - width + 1, pow(factor, -1, 2**64), U)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mix((total[width:] - total[:-width]) * back)


def window_owner(first: np.ndarray, width: int) -> np.ndarray:
    """For every place at which a window may start: true if the window stays within its text."""
    n = int(first[-1]) if len(first) else 0
    inside = np.ones(max(n - width + 1, 0), bool)
    for back in range(1, width):
        at = first[1:-1] - back
        inside[at[(at >= 0) & (at < len(inside))]] = False
    # A text shorter than the window, wherever it lies, is covered by the boundaries after it.
    return inside


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece holds much over ``most`` bytes of text (one row at least)."""
    if batch.num_rows == 0:
        return
    _, at = text_buffer(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(at, at[begin] + most, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end
