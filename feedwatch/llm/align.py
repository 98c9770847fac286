"""Alignment of two tokenizers' ids over the same bytes, and corpus-wide counts of the id pairs they link.

A byte-level BPE (A) reads each text after a blank, a SentencePiece model (B) reads the text and puts that blank
there itself, so both cover the same bytes.  The cumulative ends of each side go into a dictionary from end to index;
the intersection of the two key sets, sorted, are the common cuts.  Between two of them lies a group: one slice of each
id list.  The links of a group are its pairs of tokens whose byte ranges overlap.

Both tokenizers treat the parts of ``wordwise`` on their own and cut at their edges, so every different part of a chunk is tokenized and
aligned once, and a text's groups are its parts' groups.

What the corpus says comes in two passes.  Texts are packed into chunks; a chunk keeps the numbers of its texts' parts
and tells each different id pair once with its number of links.  Spark adds these up over the corpus,
marks the pairs whose count is the highest of their B id, and sends each chunk the counts of its own pairs only.  What is
exchanged is at most a row for each chunk and pair, however often a pair occurs.

Contracts: special tokens' strings are plain text.  A null or empty text, and one whose joined token bytes differ from
blank and text on either side (U+2581 is a blank to B), has no tokens: zeros and an empty string, and it adds to
no count.  Rows are independent; repeated rows count as often as they stand there.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwatch.llm.chunks import grow, shrink, unpack
from feedwatch.llm.tables import col, fresh, written
from feedwatch.llm.words import slices
from feedwatch.llm.wordwise import ragged, split_parts, totals

U = np.uint64
CHUNK_BYTES = 5 << 20  # of text in a chunk
JOINED = 500  # parts that the libraries get as one text
ALIGNED = 20_000  # parts whose tokens are held at once
BLANK = "▁"  # in pieces of B
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def _byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write bytes as characters: printable ones stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def byte_level(path: str):
    """The tokenizer A and the bytes of its ids."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    found.no_padding()
    found.no_truncation()
    table = _byte_characters()
    vocabulary = found.get_vocab()
    spelling = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, number in vocabulary.items():
        spelling[number] = bytes(table[c] for c in piece) if all(c in table for c in piece) else piece.encode()
    return found, spelling


@lru_cache(maxsize=2)
def piece_level(path: str):
    """The tokenizer B and the bytes of its ids."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    spelling = []
    for i in range(found.get_piece_size()):
        piece = found.id_to_piece(i)
        if found.is_byte(i):
            spelling.append(bytes([int(piece[1:-1], 16)]))
        else:
            spelling.append(piece.replace(BLANK, " ").encode())
        if BLANK in piece.lstrip(BLANK):
            raise ValueError("pieces that reach over a blank are not supported")
    return found, spelling


def align(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the groups in A's and B's tokens of these byte lengths, and the linked pairs (a, b) as rows, by a, then b."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    a_at = dict(zip(a_ends.tolist(), range(1, len(a_ends) + 1), strict=True))
    b_at = dict(zip(b_ends.tolist(), range(1, len(b_ends) + 1), strict=True))
    common = sorted(a_at.keys() & b_at.keys())
    a_cuts = np.fromiter(map(a_at.__getitem__, common), np.int64, len(common))
    b_cuts = np.fromiter(map(b_at.__getitem__, common), np.int64, len(common))
    # Within its group, a token of A is linked with the tokens of B from the one that holds its first byte to the one of its last.
    first = np.searchsorted(b_ends, a_ends - a_sizes, "right")
    count = np.searchsorted(b_ends, a_ends, "left") - first + 1
    left = np.repeat(np.arange(len(a_ends)), count)
    right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return a_cuts, b_cuts, np.stack([left, right], axis=1)


@dataclass
class Aligned:
    """What is known of the parts of a chunk, one entry a part; links lie one part after the other."""

    kept: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    texts: pa.Array  # groups, each ended by a semicolon
    pairs: np.ndarray  # a << 32 | b of each link


class PartAligner:
    """Different parts of texts to their groups and links.

    The libraries get many parts joined to one text, which is the same to them and is aligned as one: the edge of a part is a
    cut of both.  Parts with white space at an edge stand alone, as they do not join.
    """

    def __init__(self, a_path: str, b_path: str):
        (self.a, self.a_bytes), (self.b, self.b_bytes) = byte_level(a_path), piece_level(b_path)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        # Decimal ids with the sign after them: A's with a comma, A's with a bar, B's with a comma, B's with a semicolon.
        signs = [f"{i}{x}" for x in ",|" for i in range(len(self.a_bytes))] + [f"{i}{x}" for x in ",;" for i in range(len(self.b_bytes))]
        self.signs = pa.array(signs, pa.large_binary())

    def _ids(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A for a blank and the text, and of B for the text, if both spell just that."""
        own = (" " + text).encode()
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        same = b"".join([self.a_bytes[i] for i in a]) == own and b"".join([self.b_bytes[i] for i in b]) == own
        return (a, b) if same else None

    def _blocks(self, parts: list[str], kept: np.ndarray) -> Iterator[tuple[list[int], tuple[list[int], list[int]]]]:
        """Numbers of parts with the ids of their joined text; marks the parts that have none."""
        plain, blocks = [], []
        for i, part in enumerate(parts):
            awkward = part == "" or part[0] <= " " or part[0].isspace() or part[-1].isspace()
            (blocks.append([i]) if awkward else plain.append(i))
        blocks += [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
        while blocks:
            block = blocks.pop()
            found = self._ids(" ".join([parts[i] for i in block]))
            if found is not None:
                yield block, found
            elif len(block) > 1:
                blocks += [[i] for i in block]
            else:
                kept[block] = False

    def align(self, parts: list[str]) -> Aligned:
        """Parts are independent, so ``ALIGNED`` at a time bound what is held."""
        found = [self._align(parts[at : at + ALIGNED]) for at in range(0, len(parts), ALIGNED)] or [self._align(parts)]
        arrays = [np.concatenate([getattr(x, f) for x in found]) for f in ("kept", "n_a", "n_b", "n_groups", "n_links")]
        return Aligned(*arrays, pa.concat_arrays([x.texts for x in found]), np.concatenate([x.pairs for x in found]))

    def _align(self, parts: list[str]) -> Aligned:
        kept = np.ones(len(parts), bool)
        order, a, b = [], [], []
        sizes = np.fromiter((len(p.encode()) + 1 for p in parts), np.int64, len(parts))
        for block, (a_ids, b_ids) in self._blocks(parts, kept):
            order += block
            a.append(np.array(a_ids, np.int64))
            b.append(np.array(b_ids, np.int64))
        none = np.zeros((2, len(parts)), np.int64)
        if not order:
            empty = pa.array([b""] * len(parts), pa.large_binary())
            return Aligned(kept, none[0], none[0], none[0], none[0], empty, np.zeros(0, np.int64))
        own = np.array(order)
        ends = np.cumsum(sizes[own])
        cuts, links, base = [], [], np.zeros(2, np.int64)
        for a_ids, b_ids in zip(a, b, strict=True):
            a_cuts, b_cuts, found = align(self.a_sizes[a_ids], self.b_sizes[b_ids])
            cuts.append(np.stack([a_cuts, b_cuts], axis=1) + base)
            links.append(found + base)
            base += (len(a_ids), len(b_ids))
        a, b, cuts, links = (np.concatenate(x) for x in (a, b, cuts, links))
        a_part = np.searchsorted(ends, np.cumsum(self.a_sizes[a]))
        b_part = np.searchsorted(ends, np.cumsum(self.b_sizes[b]))
        group_part, link_part = a_part[cuts[:, 0] - 1], a_part[links[:, 0]]
        counts = [np.bincount(x, minlength=len(own)) for x in (a_part, b_part, group_part, link_part)]
        # Ids of a group in order, A's before B's, each with the sign that follows it.
        a_group, b_group = (np.searchsorted(cuts[:, k], np.arange(len(x)), "right") for k, x in ((0, a), (1, b)))
        a_last, b_last = (np.isin(np.arange(len(x)), cuts[:, k] - 1) for k, x in ((0, a), (1, b)))
        sign = np.concatenate([a + a_last * len(self.a_bytes), b + b_last * len(self.b_bytes) + 2 * len(self.a_bytes)])
        turn = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        spelt = self.signs.take(pa.array(sign[turn]))
        at = np.frombuffer(spelt.buffers()[1], np.int64)[spelt.offset :][np.concatenate([[0], np.cumsum(counts[0] + counts[1])])]
        texts = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(at.tobytes()), spelt.buffers()[2]])
        # Back to the order of the parts.
        place = np.full(len(parts), len(own))
        place[own] = np.arange(len(own))
        texts = pa.concat_arrays([texts, pa.array([b""], pa.large_binary())]).take(pa.array(place))
        counts = [np.append(x, 0)[place] for x in counts]
        starts = np.append(np.cumsum(np.bincount(link_part, minlength=len(own))) - np.bincount(link_part, minlength=len(own)), 0)[place]
        pairs = ragged(a[links[:, 0]] << 32 | b[links[:, 1]], starts, counts[3])
        return Aligned(kept, *counts, texts, pairs)


def _joined(texts: pa.Array, at: np.ndarray) -> Iterator[bytes]:
    """The binary values between neighbouring places, joined."""
    if len(texts) == 0:
        yield from [b""] * (len(at) - 1)
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][at].tolist()
    data = texts.buffers()[2]
    for begin, end in zip(ends, ends[1:], strict=False):
        yield data[begin:end].to_pybytes() if end > begin else b""


def _pack(a_path: str, b_path: str, digest: bool, keep: int):
    """Batches (columns, text) to chunks: texts' own figures, numbers of their parts, links of the parts, pairs and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        aligner = PartAligner(a_path, b_path)
        for whole in batches:
            for batch in slices(whole, "t", CHUNK_BYTES):
                parts, index, at = split_parts(batch.column(keep))
                found = aligner.align(parts.to_pylist())
                kept = (totals(~found.kept[index], at) == 0) & (np.diff(at) > 0)
                index = index[np.repeat(kept, np.diff(at))]
                sizes = np.where(kept, np.diff(at), 0)
                at = np.concatenate([[0], np.cumsum(sizes)])
                figures = [totals(x[index], at) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
                texts = found.texts.take(pa.array(index))
                groups = [g[:-1] for g in _joined(texts, at)]
                groups = [(hashlib.sha256(g).hexdigest() if digest else g.decode()) if g else "" for g in groups]
                out = pa.RecordBatch.from_arrays(
                    [*batch.columns[:keep], *map(pa.array, figures), pa.array(groups, pa.large_string())],
                    [f"c{i}" for i in range(keep + 5)],
                )
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, out.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                    stream.write_batch(out)
                # Links of the chunk's parts as numbers of its different pairs.
                pairs, place = np.unique(found.pairs, return_inverse=True)
                links = found.n_links
                times = np.bincount(index, minlength=len(parts))
                counts = np.bincount(place, np.repeat(times, links), minlength=len(pairs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number], pa.int64()),
                        pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                        *[pa.array([shrink(x.astype(np.uint32))], pa.binary()) for x in (sizes, index, links, place)],
                        *[pa.array([x[counts > 0]], pa.list_(pa.int64())) for x in (np.arange(len(pairs)), pairs, counts)],
                    ],
                    _CHUNK,
                )
                number += 1
                del parts, index, found, groups, out, pairs, place, texts
                pa.default_memory_pool().release_unused()

    return run


_CHUNK = ["chunk", "data", "sizes", "parts", "links", "places", "slots", "pairs", "counts"]
_CHUNK_KINDS = (
    "chunk bigint, data binary, sizes binary, parts binary, links binary, places binary, "
    "slots array<bigint>, pairs array<bigint>, counts array<bigint>"
)


def _finish(chunks: pa.Table, told: pa.Table) -> pa.Table:
    """One chunk and the corpus-wide counts of its pairs to rows of texts."""
    if chunks.num_rows == 0:
        return pa.table({})
    chunk = chunks.slice(0, 1)
    value = lambda name: grow(chunk.column(name)[0].as_py(), np.uint32).astype(np.int64)
    sizes, index, links, places = (value(x) for x in ("sizes", "parts", "links", "places"))
    slots = told.column("slot").to_numpy()
    count, best = np.zeros((2, max(int(places.max(initial=-1)), int(slots.max(initial=-1))) + 1), np.int64)
    count[slots] = told.column("total").to_numpy()
    best[slots] = told.column("best").to_numpy(zero_copy_only=False)
    parts_at, at = np.concatenate([[0], np.cumsum(links)]), np.concatenate([[0], np.cumsum(sizes)])
    batch = unpack(chunk.column("data")[0])
    figures = [pa.array(totals(totals(x[places], parts_at)[index], at)) for x in (best, count)]
    columns = [*batch.columns[:-1], *figures, batch.columns[-1].cast(pa.string())]
    return pa.table(columns, names=[f"c{i}" for i in range(len(columns))])


def align_tokenizers(
    docs: DataFrame, a_path: str, b_path: str, text: str = "text", digest: bool = False
) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every whole text (names lengthened if taken).

    ``groups`` holds A's and B's decimal ids as ``a1,a2|b1;a3|b2``, with ``digest`` the SHA-256 of that in hex.  A pair's count is
    the number of links that hold it in all of ``docs``; ``n_best`` counts a text's links whose pair has the highest count
    of all pairs with that B id (ties included), ``count_sum`` adds up the counts of its links.
    """
    names = docs.columns
    plain = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)], col(text).cast("string").alias("t"))
    chunks = written(plain.mapInArrow(_pack(a_path, b_path, digest, len(names)), _CHUNK_KINDS), "aligned", "none")
    own = chunks.select("chunk", F.inline(F.arrays_zip("slots", "pairs", "counts"))).toDF("chunk", "slot", "pair", "n")
    totalled = own.groupBy("pair").agg(F.sum("n").alias("total"))
    totalled = written(totalled.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pairs")
    highest = totalled.groupBy("b").agg(F.max("total").alias("highest"))
    counted = totalled.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    told = own.select("chunk", "slot", "pair").join(counted, "pair").select("chunk", "slot", "total", "best")
    kinds = [k for _, k in plain.dtypes[:-1]] + ["bigint"] * 6 + ["string"]
    schema = ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))
    body = chunks.select("chunk", "data", "sizes", "parts", "links", "places")
    found = body.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_finish, schema)
    taken = list(names)
    for name in COLUMNS:
        taken.append(fresh(name, taken))
    return found.toDF(*taken)
