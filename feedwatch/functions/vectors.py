"""Vector functions: cosine, masked mean pooling and the pluggable sentence encoder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedwatch.functions.text import StrCol, as_col

# A factory is called once per task and returns the encoder: sentences -> (n, dim) matrix.  A real
# model goes here; loading it inside the factory keeps it out of the serialised job.
Encoder = Callable[[list[str]], np.ndarray]
EncoderFactory = Callable[[], Encoder]

MASK_FLOOR = 1e-9  # fixed value: lower bound of the pooling denominator
HASH_DIM = 64
TOKEN_CACHE = 200_000


# ---------------------------------------------------------------- cosine


def dot(a: StrCol, b: StrCol) -> Column:
    products = F.zip_with(as_col(a), as_col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: StrCol) -> Column:
    return F.sqrt(F.aggregate(as_col(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def cosine_similarity(a: StrCol, b: StrCol) -> Column:
    """Cosine of two arrays in one row; 0 when either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


# ---------------------------------------------------------------- pooling


def masked_mean_pool(tokens: Column, mask: Column) -> Column:
    """Pool token vectors held in one row: sum(vector * mask) / max(sum(mask), floor)."""
    width = F.size(F.element_at(tokens, 1))
    zero = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))
    scaled = F.zip_with(
        tokens, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double"))
    )
    total = F.aggregate(scaled, zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    weight = F.aggregate(mask, F.lit(0.0), lambda acc, m: acc + m.cast("double"))
    return F.transform(total, lambda x: x / F.greatest(weight, F.lit(MASK_FLOOR)))


def masked_mean_pool_rows(tokens: DataFrame, owner: str, vector: str, mask: str) -> DataFrame:
    """Pool token vectors that are one row each.

    The vector sum is a built-in aggregate with map-side partial sums, so an owner holding a third
    of all tokens sends one vector per map task and is never gathered.
    """
    masked = F.transform(F.col(vector), lambda x: x.cast("double") * F.col(mask).cast("double"))
    sums = tokens.groupBy(owner).agg(
        Summarizer.sum(array_to_vector(masked)).alias("total"),
        F.sum(F.col(mask).cast("double")).alias("weight"),
    )
    floor = F.greatest(F.col("weight"), F.lit(MASK_FLOOR))
    return sums.select(
        owner, F.transform(vector_to_array("total"), lambda x: x / floor).alias("vec")
    )


# ---------------------------------------------------------------- encoder


_TOKENS = re.compile(r"[^\W_]+")


def hashed_encoder(dim: int = HASH_DIM) -> EncoderFactory:
    """Deterministic stand-in for a model: token counts in ``dim`` hashed buckets."""

    def factory() -> Encoder:
        cache: dict[str, int] = {}

        def bucket(token: str) -> int:
            found = cache.get(token)
            if found is None:
                found = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim
                if len(cache) < TOKEN_CACHE:
                    cache[token] = found
            return found

        def encode(sentences: list[str]) -> np.ndarray:
            rows, cells = [], []
            for i, sentence in enumerate(sentences):
                found = [bucket(t) for t in _TOKENS.findall(sentence.lower())]
                cells += found
                rows += [i] * len(found)
            flat = np.asarray(rows, dtype=np.int64) * dim + np.asarray(cells, dtype=np.int64)
            counts = np.bincount(flat, minlength=len(sentences) * dim)
            return counts.reshape(len(sentences), dim).astype(np.float64)

        return encode

    return factory


def hashed_vector(sentence: StrCol, dim: int = HASH_DIM) -> Column:
    """The hashed encoder as a built-in expression (same values, no Python)."""
    tokens = F.regexp_extract_all(F.lower(as_col(sentence)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    buckets = F.transform(
        tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dim
    )
    # a one-element lambda holds the buckets, or they would be hashed again for every dimension
    return F.transform(
        F.array(buckets),
        lambda held: F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda d: F.size(F.filter(held, lambda b: b == d)).cast("double"),
        ),
    )[0]


def run_once(udf):
    """Keep the optimizer from copying a Python call into a pushed-down filter (it would run twice)."""
    return udf.asNondeterministic()


def nested_sizes(array: pa.Array) -> np.ndarray:
    """Elements of each row of a list column; null rows are empty."""
    return pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def nested_offsets(array: pa.Array) -> np.ndarray:
    """Row boundaries of a list column, starting at 0 even for a sliced batch; null rows are empty."""
    return np.concatenate([[0], np.cumsum(nested_sizes(array))])


def encode_in_batches(encode: Encoder, sentences: pa.Array, batch_size: int) -> np.ndarray:
    """Run the encoder over bounded slices (a model's memory grows with the slice).

    Sentences that repeat within the Arrow batch are encoded once: feeds are full of copies.
    """
    coded = sentences.fill_null("").dictionary_encode()
    texts = coded.dictionary.to_pylist()
    blocks = [encode(texts[i : i + batch_size]) for i in range(0, len(texts), batch_size)]
    if not blocks:
        return np.zeros((0, 0))
    return np.vstack(blocks)[coded.indices.to_numpy(zero_copy_only=False)]


def encode_sentences(
    sentences: Column, factory: EncoderFactory | None = None, batch_size: int = 256
) -> Column:
    """array<string> → array<array<double>>: every sentence of the row becomes one vector."""
    make = factory or hashed_encoder()

    @F.arrow_udf("array<array<double>>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = make()
        kind = pa.list_(pa.list_(pa.float64()))
        for batch in batches:
            offsets = nested_offsets(batch)
            matrix = encode_in_batches(encode, batch.flatten(), batch_size)
            dim = matrix.shape[1]
            inner = pa.ListArray.from_arrays(
                pa.array(np.arange(len(matrix) + 1) * dim, pa.int32()),
                pa.array(matrix.ravel(), pa.float64()),
            )
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner).cast(kind)

    return run_once(encoded)(sentences)
