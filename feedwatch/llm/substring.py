"""Removal of long passages that an earlier document already has, with a count-min prefilter.

A window is ``WIDTH`` consecutive words of one document.  A window is repeated if its word sequence also
starts in a document with a smaller id; every word that a repeated window covers is removed.

1. Documents are packed into chunks of about 4 MB of text, written once, compressed.
2. Every chunk makes its part of a count-min sketch: for each sketch row, the cells its windows fall into
   (counted 1, or 2 if several windows or documents share the cell).  The sketch has four cells a
   window however large the corpus is, so a part is sent as the sorted cells that are not zero,
   cut into stripes of the cell range; a stripe's parts are merged in one task.
3. Estimates never fall short of true counts, so a window that two documents share is estimated at two or
   more in every row.  Each chunk gets back one bit for each of its cells, and only windows estimated
   as repeated are sent on, with 96 bits of hash and their smallest id in the chunk.
4. These are grouped exactly; a chunk learns which of its windows have a smaller id elsewhere.

Ids are integers; a null id comes after all others and never makes another document's window go.  Rows
with the same id do not take words from each other.  Null and blank texts have no words.  Nothing depends
on how documents fall into chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwatch.llm.chunks import gaps, grow, pack, shrink, striped, sums, unpack
from feedwatch.llm.tables import col, scalar
from feedwatch.llm.words import text_buffer, window_hashes, window_owner, word_hashes, word_spans

U = np.uint64
WIDTH = 50
CHUNK_BYTES = 4 << 20
CELLS_PER_WINDOW = 4
SKETCH_ROWS = 2
STRIPE_BITS = 23  # cells of one merge task, as a power of two
LAST = np.iinfo(np.int64).max  # stands for a null id


class Windows:
    """All windows of a chunk, and its different windows in the order of their hashes."""

    def __init__(self, data: pa.BinaryScalar, ident: int, text: int, width: int):
        self.batch = unpack(data)
        self.raw, at = text_buffer(self.batch.column(text))
        self.starts, self.ends, self.first = word_spans(self.raw, at)
        self.at = at
        ids = self.batch.column(ident).cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)
        words = word_hashes(self.raw, self.starts, self.ends)
        place = np.flatnonzero(window_owner(self.first, width)) if len(words) >= width else np.zeros(0, np.int64)
        h1 = window_hashes(words, width, 1)[place]
        h2 = window_hashes(words, width, 2)[place]
        order = np.argsort(h1, kind="stable")
        if np.any((h1[order][1:] == h1[order][:-1]) & (h2[order][1:] != h2[order][:-1])):
            order = np.lexsort((h2, h1))
        self.place = place[order]
        self.doc = ids[np.searchsorted(self.first, self.place, "right") - 1]
        h1, h2 = h1[order], h2[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        heads = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.h1, self.h2 = h1[heads], h2[heads]
        self.least = np.minimum.reduceat(self.doc, heads) if len(heads) else self.doc
        self.several = np.maximum.reduceat(self.doc, heads) != self.least if len(heads) else new

    def cells(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sketch row's cells that are not zero, whether they count two or more, each window's cell."""
        cell = (self.h1 if row == 0 else self.h2) >> U(64 - bits)
        order = np.argsort(cell, kind="stable") if row else np.arange(len(cell))
        ordered = cell[order]
        new = np.ones(len(cell), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        heads = np.flatnonzero(new)
        inverse = np.empty(len(cell), np.int64)
        inverse[order] = np.cumsum(new) - 1
        more = np.diff(heads, append=len(cell)) > 1
        if len(heads):
            more |= np.maximum.reduceat(self.several[order], heads)
        return ordered[heads], more, inverse


def _sketch(ident: int, text: int, width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                windows = Windows(data, ident, text, width)
                out: dict[str, list] = {"line": [], "stripe": [], "chunk": [], "cells": [], "more": []}
                for row in range(SKETCH_ROWS):
                    cells, more, _ = windows.cells(row, bits)
                    for stripe, a, b in striped(cells, STRIPE_BITS):
                        base = U(stripe << STRIPE_BITS)
                        for name, value in zip(out, (row, stripe, chunk, gaps(cells[a:b] - base), shrink(np.packbits(more[a:b]))), strict=True):
                            out[name].append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[n], t) for n, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], list(out)
                )

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Add up one stripe of all parts; each part gets a bit for each of its cells: two or more?"""
    counts = np.zeros(1 << STRIPE_BITS, np.uint8)
    for cells, more in zip(table.column("cells"), table.column("more"), strict=True):
        at = sums(cells.as_py()).astype(np.int64)
        own = np.unpackbits(grow(more.as_py(), np.uint8), count=len(at))
        counts[at] = np.minimum(counts[at] + 1 + own, 2)
    masks = [np.packbits(counts[sums(c.as_py()).astype(np.int64)] > 1).tobytes() for c in table.column("cells")]
    return pa.table(
        {"chunk": table.column("chunk"), "line": table.column("line"), "stripe": table.column("stripe"), "mask": pa.array(masks, pa.binary())}
    )


def _candidates(packed: pa.Table, masks: pa.Table, ident: int, text: int, width: int, bits: int) -> pa.Table:
    out: dict[str, list] = {"stripe": [], "chunk": [], "data": []}
    for chunk, data in zip(packed.column("chunk").to_pylist(), packed.column("data"), strict=True):
        windows = Windows(data, ident, text, width)
        repeated = np.ones(len(windows.h1), bool)
        found = {
            (row, stripe): mask.as_py()
            for row, stripe, mask in zip(masks.column("line").to_pylist(), masks.column("stripe").to_pylist(), masks.column("mask"), strict=True)
        }
        for row in range(SKETCH_ROWS):
            cells, _, inverse = windows.cells(row, bits)
            flags = np.zeros(len(cells), bool)
            for stripe, a, b in striped(cells, STRIPE_BITS):
                flags[a:b] = np.unpackbits(np.frombuffer(found[row, stripe], np.uint8), count=b - a).astype(bool)
            repeated &= flags[inverse]
        kept = np.flatnonzero(repeated)
        h1 = windows.h1[kept]
        # A stripe of the exact grouping holds no more windows than one of the sketch.
        for stripe, a, b in striped(h1, 64 - bits + STRIPE_BITS):
            part = kept[a:b]
            least = windows.least[part]
            parts = [
                gaps(part),
                gaps(h1[a:b]),
                shrink((windows.h2[part] >> U(32)).astype("<u4")),
                shrink((least - least.min()).view(U)),
            ]
            lengths = np.array([len(p) for p in parts], "<u4").tobytes()
            out["stripe"].append(stripe)
            out["chunk"].append(chunk)
            out["data"].append(lengths + int(least.min()).to_bytes(8, "little", signed=True) + b"".join(parts))
    return pa.table({"stripe": pa.array(out["stripe"], pa.int64()), "chunk": pa.array(out["chunk"], pa.int64()), "data": pa.array(out["data"], pa.binary())})


def _resolve(table: pa.Table) -> pa.Table:
    """Group one stripe's windows exactly; each chunk gets those that have a smaller id elsewhere."""
    places, h1, h2, ids, sizes = [], [], [], [], []
    for data in table.column("data"):
        data = data.as_py()
        lengths = np.frombuffer(data, "<u4", 4).tolist()
        base, at, parts = int.from_bytes(data[16:24], "little", signed=True), 24, []
        for n in lengths:
            parts.append(data[at : at + n])
            at += n
        places.append(sums(parts[0]))
        h1.append(sums(parts[1]))
        h2.append(grow(parts[2], "<u4"))
        ids.append(grow(parts[3], U).view(np.int64) + base)
        sizes.append(len(h1[-1]))
    first, second, ids = np.concatenate(h1), np.concatenate(h2), np.concatenate(ids)
    order = np.lexsort((second, first))
    new = np.ones(len(order), bool)
    new[1:] = (first[order][1:] != first[order][:-1]) | (second[order][1:] != second[order][:-1])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    lost = np.zeros(len(order), bool)
    lost[order] = least < ids[order]
    cuts = np.cumsum([0, *sizes])
    answers = [gaps(p[lost[a:b]]) for p, a, b in zip(places, cuts, cuts[1:], strict=False)]
    return pa.table({"chunk": table.column("chunk"), "lost": pa.array(answers, pa.binary())})


def _covered(windows: Windows, answers: list[bytes], width: int) -> np.ndarray:
    """For each word of the chunk, whether it goes."""
    lost = np.zeros(len(windows.h1), bool)
    for answer in answers:
        lost[sums(answer).astype(np.int64)] = True
    places = windows.place[lost[windows.group] | (windows.doc > windows.least[windows.group])]
    edges = np.zeros(len(windows.starts) + 1, np.int64)
    edges[places] += 1  # a place occurs once
    edges[places + width] -= 1
    return np.cumsum(edges[:-1]) > 0


def _finish(packed: pa.Table, answers: pa.Table, ident: int, text: int, width: int, digest: bool) -> pa.Table:
    windows = Windows(packed.column("data")[0], ident, text, width)
    gone = _covered(windows, [x.as_py() for x in answers.column("lost")], width)
    raw, first = windows.raw.tobytes(), windows.first.tolist()
    removed = np.concatenate([[0], np.cumsum(gone)])[windows.first]
    removed = np.diff(removed)
    out = []
    for i, (a, b) in enumerate(zip(windows.at.tolist(), windows.at.tolist()[1:], strict=False)):
        if removed[i]:
            rows = np.flatnonzero(~gone[first[i] : first[i + 1]]) + first[i]
            own = b" ".join([raw[s:e] for s, e in zip(windows.starts[rows].tolist(), windows.ends[rows].tolist(), strict=True)])
        elif digest:
            own = b" ".join(raw[a:b].split())
        else:
            own = None
        out.append(hashlib.sha256(own).hexdigest() if digest else own if own is None else own.decode())
    batch = windows.batch
    counts = [pa.array(np.diff(windows.first)), pa.array(removed)]
    if digest:
        return pa.table([batch.column(ident), *counts, pa.array(out, pa.string())], names=["id", "n_words", "n_removed", "sha"])
    texts = [t if o is None else o for o, t in zip(out, batch.column(text).to_pylist(), strict=True)]
    columns = [pa.array(texts, pa.string()) if i == text else c for i, c in enumerate(batch.columns)]
    return pa.table([*columns, *counts], names=[*batch.schema.names, "n_words", "n_removed"])


def _run(docs: DataFrame, ident: int, text: int, schema: str, digest: bool, width: int, chunk_bytes: int) -> DataFrame:
    packed = pack(docs, text, chunk_bytes)
    total = scalar(packed.agg(F.sum("words")))[0] or 0  # no fewer than there are windows
    bits = max(STRIPE_BITS, (CELLS_PER_WINDOW * total - 1).bit_length() if total else 0)
    parts = packed.select("chunk", "data").mapInArrow(
        _sketch(ident, text, width, bits), "line int, stripe bigint, chunk bigint, cells binary, more binary"
    )
    masks = parts.groupBy("line", "stripe").applyInArrow(_merge, "chunk bigint, line int, stripe bigint, mask binary")
    chunks = packed.select("chunk", "data").groupBy("chunk")
    rows = chunks.cogroup(masks.groupBy("chunk")).applyInArrow(
        partial(_candidates, ident=ident, text=text, width=width, bits=bits), "stripe bigint, chunk bigint, data binary"
    )
    answers = rows.groupBy("stripe").applyInArrow(_resolve, "chunk bigint, lost binary")
    return chunks.cogroup(answers.groupBy("chunk")).applyInArrow(
        partial(_finish, ident=ident, text=text, width=width, digest=digest), schema
    )


def repeated_words(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the words that stay, joined by one blank)."""
    plain = docs.select(col(doc_id).alias("c0"), col(text).cast("string").alias("c1"))
    schema = f"id {plain.dtypes[0][1]}, n_words bigint, n_removed bigint, sha string"
    return _run(plain, 0, 1, schema, True, width, chunk_bytes).toDF("doc_id", "n_words", "n_removed", "kept_sha256")


def drop_repeated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """``docs`` without repeated passages, and without documents of which nothing is left.

    Texts that lose nothing stay as they are, others become their remaining words joined by one
    blank.  All other columns stay, in the same order.
    """
    names = docs.columns
    plain = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)])
    schema = ", ".join([*[f"{c} {k}" for c, k in plain.dtypes], "n_words bigint, n_removed bigint"])
    found = _run(plain, names.index(doc_id), names.index(text), schema, False, width, chunk_bytes)
    return found.where("n_removed = 0 or n_removed < n_words").drop("n_words", "n_removed").toDF(*names)
