"""Documents in compressed chunks of bounded text, and number arrays in small byte strings.

A chunk is one row: a number and an Arrow stream of its documents.  Per-word work is done on a whole chunk
with numpy; what chunks exchange are byte strings for stripes of a hash range, a few bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from feedwatch.llm.tables import written
from feedwatch.llm.words import slices, text_buffer, word_spans

U = np.uint64


def shrink(values: np.ndarray) -> bytes:
    """Compressed, one byte plane after the other: the leading planes are nearly constant."""
    width = values.dtype.itemsize
    if values.dtype.kind == "u":
        top = int(values.max()) if len(values) else 0
        while width > 1 and top >> (8 * (width - 1)) == 0:
            width -= 1
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)[:, :width].T.tobytes()
    return bytes([width]) + zstandard.ZstdCompressor(1).compress(planes)


def grow(data: bytes, dtype) -> np.ndarray:
    """The array that ``shrink`` got."""
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(dtype)


def gaps(values: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return shrink(np.diff(values.astype(U), prepend=U(0)))


def sums(data: bytes) -> np.ndarray:
    """The numbers that ``gaps`` got."""
    return np.cumsum(grow(data, U), dtype=U)


def striped(values: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(stripe, begin, end) of sorted numbers, cut by their bits above ``shift``."""
    if len(values):
        stripes = (values >> U(shift)).astype(np.int64) if shift < 64 else np.zeros(len(values), np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(stripes)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield int(stripes[a]), a, b


def pack(docs: DataFrame, text: int, chunk_bytes: int) -> DataFrame:
    """Rows (chunk, data, words) of documents in columns c0, c1, ...; the text is column ``text``.

    Written once: later passes see the same chunks whatever becomes of executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, f"c{text}", chunk_bytes):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(batch)
                words = len(word_spans(*text_buffer(batch.column(text)))[0])
                yield pa.RecordBatch.from_pydict(
                    {
                        "chunk": pa.array([number], pa.int64()),
                        "data": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                        "words": pa.array([words], pa.int64()),
                    }
                )
                number += 1

    return written(docs.mapInArrow(run, "chunk bigint, data binary, words bigint"), "chunks", "none")


def unpack(data: pa.BinaryScalar) -> pa.RecordBatch:
    with pa.ipc.open_stream(data.as_buffer()) as source:
        return source.read_next_batch()
