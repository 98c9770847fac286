"""Language-model scores from a subword lattice over an existing piece vocabulary.

A word's probability is the sum over all ways to cut it into pieces of the product of the pieces'
probabilities, by a forward recursion in log space.  Pieces begin with probabilities from the ranks of the
vocabulary file and are re-estimated on the training words by expected counts over all segmentations.
The word as a whole is one more edge of its lattice, with its share of the training words; the mass of
words seen once (Good-Turing) is what all segmentations into pieces share.  A document's probability is
the product over its words and its end.

Counts cover all training documents.  The word table is spread over stripes of a hash range and never
broadcast: each chunk of documents asks for its own different words and gets back count and probability.
Only sums (as many as there are pieces) reach the driver.  Null texts are empty: an end without words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwatch.llm.chunks import gaps, grow, pack, shrink, striped, sums, unpack
from feedwatch.llm.labels import is_held_out
from feedwatch.llm.pieces import BLANK, BYTE, NORMAL, USER, PieceModel, by_length
from feedwatch.llm.tables import col, scalar, written
from feedwatch.llm.words import text_buffer, word_hashes, word_spans

U = np.uint64
CHUNK_BYTES = 8 << 20
STRIPE_WORDS = 4 << 20  # running words that a stripe of the word table stands for
ROUNDS = 2  # of re-estimation
PRIOR = 0.1  # added to each piece's expected count


@dataclass
class Lattice:
    """Pieces with the natural logarithms of their probabilities."""

    model: PieceModel
    logs: np.ndarray

    @classmethod
    def from_ranks(cls, model: PieceModel) -> Lattice:
        """Zipf's law on the order of the file's scores; bytes share what the last piece has."""
        kinds = model.kinds
        usable = np.isin(kinds, (NORMAL, USER))
        rank = np.empty(len(kinds))
        rank[np.argsort(np.where(usable, -model.scores, np.inf), kind="stable")] = np.arange(len(kinds))
        weight = np.where(usable, 1 / (rank + 2.7), 0.0)
        weight[kinds == BYTE] = weight[usable].min() / 8 if usable.any() else 1.0
        return cls(model, np.log(np.maximum(weight / weight.sum(), 1e-300)))

    def _alone(self, codes: np.ndarray) -> np.ndarray:
        """For every code point of ``codes``, the sum of its bytes' logarithms."""
        different, place = np.unique(codes, return_inverse=True)
        value = np.array([self.logs[self.model.by_byte[list(chr(c).encode("utf-8", "replace"))]].sum() for c in different.tolist()])
        return value[place.reshape(codes.shape)]

    def _edges(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(end, first start, piece ids, logarithms) of the words' lattices, one end after the other."""
        alone = self._alone(codes)
        for end, first, ids in self.model.lattice(codes):
            value = np.where(ids >= 0, self.logs[np.maximum(ids, 0)], -np.inf)
            single = ids[-1] < 0
            value[-1, single] = alone[single, end - 1]
            yield end, first, ids, value

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """Natural logarithm of each word's probability, summed over all segmentations."""
        out = np.zeros(len(words))
        for rows, codes in by_length([BLANK + w for w in words]):
            forward = np.zeros((codes.shape[1] + 1, len(rows)))
            for end, first, _, value in self._edges(codes):
                forward[end] = _log_sum(value + forward[first:end])
            out[rows] = forward[-1]
        return out

    def expected_counts(self, words: list[str], times: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, words counted ``times``."""
        counts = np.zeros(len(self.logs))
        for rows, codes in by_length([BLANK + w for w in words], 1 << 18):
            size = codes.shape[1]
            forward = np.zeros((size + 1, len(rows)))
            edges = []
            for end, first, ids, value in self._edges(codes):
                forward[end] = _log_sum(value + forward[first:end])
                edges.append((end, first, ids.astype(np.int32), value.astype(np.float32)))
            backward = np.full((size + 1, len(rows)), -np.inf)
            backward[-1] = 0.0
            for end, first, ids, value in reversed(edges):
                share = np.exp(forward[first:end] + value + backward[end] - forward[-1]) * times[rows]
                np.logaddexp(backward[first:end], value + backward[end], out=backward[first:end])
                known = ids >= 0
                counts += np.bincount(ids[known], weights=share[known], minlength=len(counts))
                for k in np.flatnonzero(~known[-1] & (share[-1] > 0)).tolist():
                    spelt = self.model.by_byte[list(chr(codes[k, end - 1]).encode("utf-8", "replace"))]
                    np.add.at(counts, spelt, share[-1, k])
        return counts

    def updated(self, counts: np.ndarray) -> Lattice:
        usable = np.isin(self.model.kinds, (NORMAL, USER, BYTE))
        weight = np.where(usable, counts + PRIOR, 0.0)
        return Lattice(self.model, np.log(np.maximum(weight / weight.sum(), 1e-300)))


def _log_sum(values: np.ndarray) -> np.ndarray:
    top = values.max(axis=0)
    top[~np.isfinite(top)] = 0.0
    with np.errstate(divide="ignore"):
        return np.log(np.exp(values - top).sum(axis=0)) + top


class ChunkWords:
    """Words of a chunk, A-Z lowered, and the different ones in the order of their hashes."""

    def __init__(self, data: pa.BinaryScalar):
        self.batch = unpack(data)
        raw, at = text_buffer(self.batch.column(2))
        self.raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw).astype(np.uint8)
        self.starts, self.ends, self.first = word_spans(self.raw, at)
        hashes, self.one, self.which = np.unique(word_hashes(self.raw, self.starts, self.ends), return_index=True, return_inverse=True)
        self.hashes = hashes

    def training_counts(self) -> np.ndarray:
        training = ~self.batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        flags = np.repeat(training, np.diff(self.first))
        return np.bincount(self.which[flags], minlength=len(self.hashes))

    def spelt(self, a: int, b: int) -> bytes:
        raw = self.raw.tobytes()
        one = self.one[a:b]
        return b" ".join([raw[s:e] for s, e in zip(self.starts[one].tolist(), self.ends[one].tolist(), strict=True)])


def _parts(shift: int, with_words: bool):
    """Chunks to rows (stripe, chunk, hashes, counts, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = ChunkWords(data)
                counts = own.training_counts().astype(U)
                spans = list(striped(own.hashes, shift))
                packer = zstandard.ZstdCompressor(1)
                columns = [
                    pa.array([s for s, _, _ in spans], pa.int64()),
                    pa.array([chunk] * len(spans), pa.int64()),
                    pa.array([gaps(own.hashes[a:b]) for _, a, b in spans], pa.binary()),
                ]
                names = ["stripe", "chunk", "hashes"]
                if with_words:
                    columns += [
                        pa.array([shrink(counts[a:b]) for _, a, b in spans], pa.binary()),
                        pa.array([packer.compress(own.spelt(a, b)) for _, a, b in spans], pa.binary()),
                    ]
                    names += ["counts", "words"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _merge(table: pa.Table) -> pa.Table:
    """Add up one stripe: each different word once, in the order of hashes, with its training count."""
    hashes = [sums(x.as_py()) for x in table.column("hashes")]
    counts = np.concatenate([grow(x.as_py(), U) for x in table.column("counts")])
    spelt: list[bytes] = []
    for x in table.column("words"):
        spelt += zstandard.ZstdDecompressor().decompress(x.as_py()).split(b" ")
    different, one, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    total = np.bincount(which, weights=counts.astype(float)).astype(U)
    words = zstandard.ZstdCompressor(1).compress(b" ".join([spelt[i] for i in one.tolist()]))
    return pa.table(
        {
            "stripe": table.column("stripe").slice(0, 1),
            "hashes": pa.array([gaps(different)], pa.binary()),
            "counts": pa.array([shrink(total)], pa.binary()),
            "words": pa.array([words], pa.binary()),
            "tokens": pa.array([int(total.sum())], pa.int64()),
            "types": pa.array([int((total > 0).sum())], pa.int64()),
            "once": pa.array([int((total == 1).sum())], pa.int64()),
        }
    )


def _word_list(data: bytes) -> list[str]:
    return zstandard.ZstdDecompressor().decompress(data).decode().split(" ")


def _expected(shared):
    """Stripes of the word table to rows (piece, n); every different training word counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.logs))
        for batch in batches:
            for counts, words in zip(batch.column(0), batch.column(1), strict=True):
                seen = grow(counts.as_py(), U) > 0
                names = [w for w, s in zip(_word_list(words.as_py()), seen.tolist(), strict=True) if s]
                total += shared.value.expected_counts(names, np.ones(len(names)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(used, pa.int64()), "n": pa.array(total[used])})

    return run


def train(table: DataFrame, model: PieceModel, rounds: int = ROUNDS) -> Lattice:
    """Re-estimate piece probabilities on a word table."""
    lattice = Lattice.from_ranks(model)
    for _ in range(rounds):
        shared = table.sparkSession.sparkContext.broadcast(lattice)  # one vocabulary file and a number a piece
        rows = table.select("counts", "words").mapInArrow(_expected(shared), "piece bigint, n double")
        counts = np.zeros(len(lattice.logs))
        for row in rows.groupBy("piece").agg(F.sum("n").alias("n")).collect():  # at most one row a piece
            counts[row["piece"]] = row["n"]
        lattice = lattice.updated(counts)
    return lattice


@dataclass
class Shares:
    """How training words and new ones share the probability of a word."""

    words: int
    ends: int
    types: int
    once: int

    @property
    def new(self) -> float:
        """Good-Turing mass of words not seen in training."""
        return 1.0 if not self.words else min(max(self.once, 1) / (self.words + 1), 0.999)

    @property
    def end(self) -> float:
        return (self.ends + 0.5) / (self.words + self.ends + 1)

    def log10(self, counts: np.ndarray, log_lattice: np.ndarray) -> np.ndarray:
        """log10 probability of words with these training counts and lattice logarithms."""
        with np.errstate(divide="ignore"):
            known = np.log(counts * ((1 - self.new) / max(self.words, 1)))
        return (np.logaddexp(known, log_lattice + np.log(self.new)) + np.log1p(-self.end)) / np.log(10)


def _scored(shared, shares: Shares):
    """Stripes of the word table to (stripe, hashes, counts, logs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = []
            for counts, words in zip(batch.column(2), batch.column(3), strict=True):
                value = shares.log10(grow(counts.as_py(), U).astype(float), shared.value.log_probabilities(_word_list(words.as_py())))
                logs.append(shrink(value.astype("<f8")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(logs, pa.binary())], ["stripe", "hashes", "counts", "logs"]
            )

    return run


def _answer(asked: pa.Table, table: pa.Table) -> pa.Table:
    """Each chunk's words of a stripe to their counts and logarithms, in the chunk's order."""
    hashes = sums(table.column("hashes")[0].as_py())
    counts = grow(table.column("counts")[0].as_py(), U)
    logs = grow(table.column("logs")[0].as_py(), "<f8").astype("<f4")
    at = [np.searchsorted(hashes, sums(x.as_py())) for x in asked.column("hashes")]
    return pa.table(
        {
            "chunk": asked.column("chunk"),
            "stripe": asked.column("stripe"),
            "counts": pa.array([shrink(counts[x]) for x in at], pa.binary()),
            "logs": pa.array([shrink(logs[x]) for x in at], pa.binary()),
        }
    )


def _document_scores(packed: pa.Table, answers: pa.Table, shares: Shares) -> pa.Table:
    own = ChunkWords(packed.column("data")[0])
    answers = answers.sort_by("stripe")
    empty = np.zeros(0)
    counts = np.concatenate([empty, *[grow(x.as_py(), U).astype(float) for x in answers.column("counts")]])
    logs = np.concatenate([empty, *[grow(x.as_py(), "<f4").astype(float) for x in answers.column("logs")]])
    below = np.log10(shares.words + shares.ends + 0.5 * (shares.types + (shares.ends > 0) + 1))
    base = np.log10(counts + 0.5) - below
    sizes = np.diff(own.first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    add = lambda values: np.bincount(owner, weights=values[own.which], minlength=len(sizes))
    return pa.table(
        {
            "id": own.batch.column(0),
            "held_out": own.batch.column(1),
            "n_tokens": pa.array(sizes + 1),
            "n_known": pa.array(add((counts > 0).astype(float)).astype(np.int64) + (shares.ends > 0)),
            "base": pa.array(add(base) + np.log10(shares.ends + 0.5) - below),
            "score": pa.array(add(logs) + np.log10(shares.end)),
        }
    )


def lattice_scores(docs: DataFrame, model: PieceModel, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    ``base_score`` is that of single words with half a count added; ``score`` is the lattice's, in log10.
    """
    plain = docs.select(col(doc_id).alias("c0"), is_held_out(col(doc_id), 5, 1).alias("c1"), col(text).cast("string").alias("c2"))
    packed = pack(plain, 2, CHUNK_BYTES)
    ends = scalar(plain.agg(F.count_if(~F.col("c1"))))[0]
    total = scalar(packed.agg(F.sum("words")))[0] or 0
    shift = 64 - max(0, -(-total // STRIPE_WORDS) - 1).bit_length()
    chunks = packed.select("chunk", "data")
    parts = chunks.mapInArrow(_parts(shift, True), "stripe bigint, chunk bigint, hashes binary, counts binary, words binary")
    table = written(
        parts.groupBy("stripe").applyInArrow(
            _merge, "stripe bigint, hashes binary, counts binary, words binary, tokens bigint, types bigint, once bigint"
        ),
        "words",
        "none",
    )
    row = scalar(table.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("tokens", "types", "once")]))
    shares = Shares(row[0], ends, row[1], row[2])
    lattice = train(table, model, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(lattice)
    scored = table.select("stripe", "hashes", "counts", "words").mapInArrow(
        _scored(shared, shares), "stripe bigint, hashes binary, counts binary, logs binary"
    )
    asked = chunks.mapInArrow(_parts(shift, False), "stripe bigint, chunk bigint, hashes binary")
    answers = asked.groupBy("stripe").cogroup(scored.groupBy("stripe")).applyInArrow(
        _answer, "chunk bigint, stripe bigint, counts binary, logs binary"
    )
    found = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        partial(_document_scores, shares=shares),
        f"id {plain.dtypes[0][1]}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double",
    )
    return found.select(
        F.col("id").alias("doc_id"),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(shares.words + shares.ends).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
