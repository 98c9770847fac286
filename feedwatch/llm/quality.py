"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer network.

A token (a run of letters and digits, lower-cased, or a run of signs) has a sparse random index vector,
made from its hash.  A token's word vector is its index vector plus the mean of those of its neighbours
up to two tokens away, over the sample; a token that the sample lacks has its index vector only.  A
document is the mean and the spread of its word vectors, with a few figures on their repetition and
case, and goes through a network of one hidden layer whose probabilities are calibrated by a
temperature on rows kept apart.

Everything is fitted in one task on a bounded sample of labelled rows (``labels.SAMPLE_ROWS``, texts
cut nowhere).  Null and empty texts are documents without tokens and get a score like any other.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwatch.llm.labels import SAMPLE_ROWS, is_held_out, labelled_sample
from feedwatch.llm.pieces import SortedKeys
from feedwatch.llm.tables import col
from feedwatch.llm.words import mix, slices, text_buffer, word_hashes

U = np.uint64
DIM = 48
NONZERO = 4
NEIGHBOURS = 2
HIDDEN = 24
EPOCHS = 120
LEAST_COUNT = 3  # occurrences in the sample for a vector of its own
SLICE_BYTES = 1 << 20

_KIND = np.full(256, 2, np.uint8)  # 0 blank, 1 letters and digits (all bytes of other scripts), 2 signs
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token, whether it has two capitals or more, and each text's first token."""
    raw, at = text_buffer(texts)
    if len(raw) == 0:
        return np.zeros(0, U), np.zeros(0, bool), np.zeros(len(at), np.int64)
    kind = _KIND[raw]
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[at] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    capital = (raw >= 65) & (raw <= 90)
    lowered = np.where(capital, raw | 32, raw).astype(np.uint8)
    capitals = np.concatenate([[0], np.cumsum(capital, dtype=np.int32)])
    return word_hashes(lowered, starts, ends), capitals[ends] - capitals[starts] > 1, np.searchsorted(starts, at)


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """Sparse random vectors of -1, 0 and 1, the same for the same token everywhere."""
    out = np.zeros((len(hashes), DIM), np.float32)
    rows = np.arange(len(hashes))
    for k in range(NONZERO):
        draw = mix(hashes ^ U(k + 1))
        out[rows, (draw % U(DIM)).astype(np.int64)] += np.where(draw >> U(63), np.float32(1), np.float32(-1))
    return out


@dataclass
class Model:
    hashes: np.ndarray  # tokens with a vector of their own
    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def keys(self) -> SortedKeys:
        return SortedKeys(self.hashes, np.arange(len(self.hashes)))


def pooled(texts: pa.Array, keys: SortedKeys, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: mean and spread of its word vectors, and figures on repetition and case."""
    hashes, shouted, first = tokens(texts)
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    own = keys.probe(hashes)
    own_known = own >= 0
    known_rows = vectors[np.maximum(own, 0)]
    if not own_known.all():
        known_rows[~own_known] = index_vectors(hashes[~own_known])
    some = np.flatnonzero(sizes > 0)
    total, square = np.zeros((len(sizes), DIM)), np.zeros((len(sizes), DIM))
    if len(some):
        total[some] = np.add.reduceat(known_rows, first[:-1][some], axis=0)
        np.multiply(known_rows, known_rows, out=known_rows)
        square[some] = np.add.reduceat(known_rows, first[:-1][some], axis=0)
    count = np.maximum(sizes, 1)[:, None]
    mean = total / count
    spread = np.sqrt(np.maximum(square / count - mean**2, 0))
    # Different tokens of each text, neighbours that are equal, tokens in capitals.
    order = np.lexsort((hashes, owner)) if len(hashes) else np.zeros(0, np.int64)
    different = np.ones(len(order), bool)
    different[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    add = lambda flags, who: np.bincount(who, weights=flags.astype(float), minlength=len(sizes))[:, None] / count
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    return np.hstack(
        [
            mean,
            spread,
            np.sqrt((mean**2).sum(axis=1, keepdims=True)),
            np.log1p(sizes)[:, None],
            add(different, owner[order]),
            add(same, owner),
            add(shouted, owner),
        ]
    )


def word_vectors(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that occur often enough and their vectors: index vector plus the neighbours' mean."""
    hashes, _, first = tokens(texts)
    names, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    base = index_vectors(names)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total, seen = np.zeros((len(names), DIM), np.float64), np.zeros(len(names))
    for step in range(1, NEIGHBOURS + 1):
        inside = owner[step:] == owner[:-step]
        for a, b in ((which[:-step][inside], which[step:][inside]), (which[step:][inside], which[:-step][inside])):
            seen += np.bincount(a, minlength=len(names))
            for d in range(DIM):
                total[:, d] += np.bincount(a, weights=base[b, d], minlength=len(names))
    vectors = base + (total / np.maximum(seen, 1)[:, None]).astype(np.float32)
    often = counts >= LEAST_COUNT
    return names[often], vectors[often]


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ layers[0] + layers[1], 0)
    return hidden, hidden @ layers[2] + layers[3]


def _train(x: np.ndarray, y: np.ndarray, seed: int) -> list[np.ndarray]:
    """Two layers by Adam on the logistic loss, mini-batches in a seeded order."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            rows = order[at : at + 256]
            hidden, logit = _forward(x[rows], layers)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (hidden > 0)
            slopes = [x[rows].T @ back + 1e-4 * layers[0], back.sum(axis=0), hidden.T @ error + 1e-4 * layers[2], np.array([error.sum()])]
            step += 1
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] -= 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def _temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    options = np.exp(np.linspace(np.log(0.25), np.log(8), 141))
    loss = [np.mean(np.logaddexp(0, logit / t) - y * logit / t) for t in options]
    return float(options[int(np.argmin(loss))])


def fit(table: pa.Table, seed: int = 4) -> Model:
    """A model from rows (id, text, label) in the order of their ids; a fifth calibrates."""
    table = table.sort_by("id")
    # Long offsets: the texts of a sample are one array, whatever their size.
    texts, y = table.column("text").cast(pa.large_string()).combine_chunks(), table.column("label").to_numpy().astype(float)
    texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
    names, vectors = word_vectors(texts)
    keys = SortedKeys(names, np.arange(len(names)))
    if len(vectors) == 0:
        vectors = np.zeros((1, DIM), np.float32)
    parts = [pooled(texts.slice(a, 200), keys, vectors) for a in range(0, len(texts), 200)]
    x = np.vstack(parts) if parts else np.zeros((0, 2 * DIM + 5))
    if len(set(y.tolist())) < 2 or len(y) < 50:
        rate = (y.sum() + 0.5) / (len(y) + 1)
        width = 2 * DIM + 5
        flat = [np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.array([np.log(rate / (1 - rate))])]
        return Model(names, vectors, np.zeros(width), np.ones(width), flat, 1.0)
    shift, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.clip((x - shift) / scale, -8, 8)
    apart = np.random.default_rng(seed).random(len(y)) < 0.2
    layers = _train(x[~apart], y[~apart], seed)
    return Model(names, vectors, shift, scale, layers, _temperature(_forward(x[apart], layers)[1], y[apart]))


def learn(sample: DataFrame) -> bytes:
    """The model as bytes: fitted in one task, as the sample is bounded."""
    rows = sample.select("id", "text", "label").coalesce(1).mapInArrow(_fit_all, "model binary")
    return bytes(rows.first()["model"])


def _fit_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = list(batches)
    table = pa.Table.from_batches(found) if found else pa.table({"id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "label": pa.array([], pa.int32())})
    yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(fit(table))], pa.binary())})


def score(docs: DataFrame, model: bytes, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score``, the probability of label 1."""
    plain = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(keep)], col(text).cast("string").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vectors of a bounded sample's tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = pickle.loads(shared.value)
        keys = own.keys()
        for whole in batches:
            for batch in slices(whole, "t", SLICE_BYTES):
                x = pooled(batch.column(len(keep)), keys, own.vectors)
                logit = _forward(np.clip((x - own.shift) / own.scale, -8, 8), own.layers)[1] / own.temperature
                value = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value)], [*batch.schema.names[:-1], "score"])

    found = plain.mapInArrow(run, ", ".join([*[f"{n} {k}" for n, k in plain.dtypes[:-1]], "score double"]))
    return found.toDF(*keep, "score")


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    model = learn(labelled_sample(docs, labels, "quality", 3, 1, rows))
    found = score(docs, model, ["doc_id"])
    return found.select(
        "doc_id", is_held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
