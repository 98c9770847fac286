"""SentencePiece encoding and decoding: a batched Viterbi recursion over words of equal length.

All words of one length advance together: for each end position, hashes of the substrings that end
there probe the sorted keys of the vocabulary, each found piece extends the best path to its start,
and the maxima over starts are the backpointers.

What makes a path best depends on the kind of model.  A *unigram* model adds piece scores.  In a
*BPE* model scores are merge ranks, whose sums mean nothing; there a path is admissible if each two
neighbouring pieces would also stand as they are after merging their text alone, exactly one piece
can then end the path at each position, and the recursion finds just what merging finds.  Both give
the ids of the ``sentencepiece`` library (see the tests).

Contracts: a null text is an empty one and has no pieces.  Characters without a piece become their
bytes' pieces.  Decoding restores the text exactly, but for U+2581, which stands for a blank.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from feedwatch.llm.tables import col, fresh
from feedwatch.llm.words import mix, slices

U = np.uint64
BLANK = "▁"
# Fixed values of the model file's format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0  # below the lowest score, for a character without a piece in a unigram model
_FACTOR = 0x9E3779B97F4A7C15
SLICE_BYTES = 4 << 20  # of text that is encoded at once
CACHE_WORDS = 400_000  # words a Python worker remembers; then it starts anew


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of the fields of one protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            size, i = (4, i) if tag & 7 == 5 else (8, i) if tag & 7 == 1 else varint(i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class SortedKeys:
    """Sorted 64-bit keys with a number each; the leading bits of a mixed key say where to look."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        mixed = mix(keys.astype(U))
        order = np.argsort(mixed)
        self.keys, self.numbers = mixed[order], numbers[order].astype(np.int64)
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift = U(64 - bits)
        self.start = np.searchsorted((self.keys >> self.shift).astype(np.int64), np.arange(2**bits + 1)).astype(np.int32)
        self.chain = int(np.diff(self.start).max()) if len(keys) else 0
        self.keys = np.concatenate([self.keys, np.zeros(self.chain + 1, U)])
        self.numbers = np.concatenate([self.numbers, np.full(self.chain + 1, -1)])

    def probe(self, keys: np.ndarray, missing: int = -1) -> np.ndarray:
        mixed = mix(keys.astype(U, copy=False))
        at = self.start[(mixed >> self.shift).astype(np.int64)]
        out = np.full(keys.shape, missing, np.int64)
        for step in range(self.chain):
            hit = self.keys[at + step] == mixed
            out[hit] = self.numbers[(at + step)[hit]]
        return out


class PieceModel:
    """Vocabulary of a SentencePiece model file, as arrays that travel well to Python workers."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], model: int, prefix: bool = True):
        self.pieces, self.kinds, self.model, self.prefix = pieces, np.array(kinds), model, prefix
        self.scores = np.array(scores, np.float32).astype(np.float64)
        found = [i for i, k in enumerate(kinds) if k in (NORMAL, USER) and pieces[i]]
        if any(BLANK in pieces[i].lstrip(BLANK) for i in found):
            raise ValueError("pieces that reach over a blank are not supported")
        self.longest = max((len(pieces[i]) for i in found), default=1)
        hashes = np.array([_hash_text(pieces[i]) for i in found], U)
        self.keys = SortedKeys(hashes, np.array(found, np.int64))
        self.by_byte = np.full(256, kinds.index(UNKNOWN) if UNKNOWN in kinds else 0, np.int64)
        for i, k in enumerate(kinds):
            if k == BYTE:
                self.by_byte[int(pieces[i][1:-1], 16)] = i
        self.byte_fallback = BYTE in kinds
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        self.lowest = min((self.scores[i] for i in found), default=0.0) - UNKNOWN_PENALTY
        if model == BPE:
            self._rank(found)

    def _rank(self, found: list[int]) -> None:
        """Numbers for pieces: single characters first, then merges in their order; their last merges."""
        single = [i for i in found if len(self.pieces[i]) == 1]
        merged = sorted((i for i in found if len(self.pieces[i]) > 1), key=lambda i: -self.scores[i])
        order = single + merged
        number = {self.pieces[i]: n + 1 for n, i in enumerate(order)}  # 0: a character without a piece
        self.number = np.zeros(len(self.pieces), np.int64)
        self.number[order] = np.arange(1, len(order) + 1)
        self.first_merge = len(single) + 1
        self.left, self.right = np.arange(len(order) + 1), np.arange(len(order) + 1)
        pairs: dict[int, int] = {}
        self.base = len(order) + 1
        for i in merged:
            text, own = self.pieces[i], number[self.pieces[i]]
            for cut in range(1, len(text)):
                a, b = number.get(text[:cut], 0), number.get(text[cut:], 0)
                if a and b:
                    pairs[a * self.base + b] = own
        for i in merged:
            own = number[self.pieces[i]]
            parts = [number.get(c, 0) for c in self.pieces[i]]
            while len(parts) > 2:
                options = [(pairs.get(a * self.base + b, own), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
                best, k = min(options)
                if best >= own:
                    break
                parts[k : k + 2] = [best]
            if len(parts) == 2:
                self.left[own], self.right[own] = parts
            else:
                self.left[own] = self.right[own] = -1  # merging never makes this piece
        self.pairs = SortedKeys(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))

    @classmethod
    def read(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, scores, kinds, model, prefix = [], [], [], UNIGRAM, True
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, NORMAL))
            elif number == 2:
                model = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                rules = dict(_fields(value))
                prefix = bool(rules.get(3, 1))
                if rules.get(2) or rules.get(4, 1):
                    raise ValueError("only models that leave texts as they are (identity, blanks kept) are supported")
        return cls(pieces, scores, kinds, model, prefix)

    def _stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where merging the text of pieces numbered ``a`` and ``b`` leaves just these two.

        The later of all merges inside the two is undone again and again; had the pair at the seam been
        mergeable before that merge (or at the same time, further left), it would not stand.
        """
        result = (self.left[b] >= 0) & (self.left[a] >= 0)
        rows = np.flatnonzero(result)
        a, b = a[rows], b[rows]
        limit = np.full(len(rows), self.base + 1)
        while len(rows):
            blocked = self.pairs.probe(a * self.base + b, self.base + 1) < limit
            result[rows[blocked]] = False
            later_a = a > b
            go = ~blocked & (np.maximum(a, b) >= self.first_merge)
            rows, a, b, later_a = rows[go], a[go], b[go], later_a[go]
            limit = np.where(later_a, a, b + 1)
            a, b = np.where(later_a, self.right[a], a), np.where(later_a, b, self.left[b])
        return result

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Piece ids of each word, as little-endian int32; words of one length advance together."""
        out = [b""] * len(words)
        for rows, codes in by_length(words):
            for i, ids in zip(rows.tolist(), self._viterbi(codes), strict=True):
                out[i] = ids
        return out

    def lattice(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(end, first start, piece ids by start and word) for each end in words of one length.

        ``codes`` has a row of code points for each word.  -1 says that no piece spans from start to end.
        """
        count, size = codes.shape
        powers = np.full(size + 1, _FACTOR, U)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        back = np.full(size + 1, pow(_FACTOR, -1, 2**64), U)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        sums = np.zeros((size + 1, count), U)
        np.cumsum((codes.T.astype(U) + U(1)) * powers[:size, None], axis=0, out=sums[1:])
        for end in range(1, size + 1):
            first = max(0, end - self.longest)
            yield end, first, self.keys.probe((sums[end][None, :] - sums[first:end]) * back[first:end][:, None])

    def _viterbi(self, codes: np.ndarray) -> list[bytes]:
        count, size = codes.shape
        best = np.full((size + 1, count), -np.inf)
        best[0] = 0.0
        begin = np.zeros((size + 1, count), np.int32)
        last = np.full((size + 1, count), -1, np.int32)
        for end, first, ids in self.lattice(codes):
            starts = np.arange(first, end)
            single = ids[-1] < 0  # the last character alone, without a piece
            if self.model == BPE:
                value = np.full(ids.shape, -np.inf)
                rows, cols = np.nonzero((ids >= 0) & np.isfinite(best[first:end]))
                before = last[starts[rows], cols]
                numbers = np.where(before >= 0, self.number[before], 0)
                fits = (starts[rows] == 0) | self._stand(numbers, self.number[ids[rows, cols]])
                value[rows[fits], cols[fits]] = 0.0
                # At a text's start the piece itself must be one that merging makes.
                lone = starts[rows] == 0
                made = self.left[self.number[ids[rows, cols]]] >= 0
                value[rows[lone & ~made], cols[lone & ~made]] = -np.inf
                value[-1, single] = best[end - 1, single]
            else:
                value = best[first:end] + np.where(ids >= 0, self.scores[np.maximum(ids, 0)], -np.inf)
                value[-1, single] = best[end - 1, single] + self.lowest
            pick = value.argmax(axis=0)
            best[end] = value[pick, np.arange(count)]
            begin[end] = starts[pick]
            last[end] = ids[pick, np.arange(count)]
        return self._trace(codes, begin, last)

    def _trace(self, codes: np.ndarray, begin: np.ndarray, last: np.ndarray) -> list[bytes]:
        """Follow the backpointers of all words at once, then put pieces (or bytes) in order."""
        size, count = begin.shape[0] - 1, begin.shape[1]
        at, rows = np.full(count, size), np.arange(count)
        owners, ends, ids = [], [], []
        while len(rows):
            owners.append(rows)
            ends.append(at)
            ids.append(last[at, rows])
            at = begin[at, rows].astype(np.int64)
            rows, at = rows[at > 0], at[at > 0]
        owners, ends, ids = map(np.concatenate, (owners, ends, ids))
        order = np.lexsort((ends, owners))
        owners, ends, ids = owners[order], ends[order], ids[order]
        if (missing := np.flatnonzero(ids < 0)).size:
            if self.byte_fallback:
                spelt = [
                    self.by_byte[list(chr(codes[o, e - 1]).encode("utf-8", "replace"))]
                    for o, e in zip(owners[missing].tolist(), ends[missing].tolist(), strict=True)
                ]
            else:
                # Neighbouring unknown characters are one unknown piece.
                follows = (np.diff(missing, prepend=-9) == 1) & (owners[missing] == owners[missing - 1])
                spelt = [np.full(0 if f else 1, self.unknown) for f in follows]
            times = np.ones(len(ids), np.int64)
            times[missing] = list(map(len, spelt))
            owners = np.repeat(owners, times)
            ids = np.repeat(ids, times)
            ids[ids < 0] = np.concatenate(spelt)
        cuts = (np.searchsorted(owners, np.arange(count + 1)) * 4).tolist()
        packed = ids.astype("<i4").tobytes()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    @property
    def cutter(self) -> re.Pattern:
        """Words: a run of blanks and what follows it; characters that no piece holds stand alone."""
        alone = "" if "\n" in "".join(self.pieces) or not self.byte_fallback else r"\n"
        rest = rf"[^{BLANK}{alone}]"
        return re.compile(rf"{BLANK}+{rest}*|{rest}+" + (rf"|{alone}" if alone else ""))

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self._spelling[ids]).decode("utf-8", "replace")[1 if self.prefix and len(ids) else 0 :]

    @property
    def _spelling(self) -> np.ndarray:
        table = self.__dict__.get("_table")
        if table is None:
            table = np.empty(len(self.pieces), object)
            for i, (piece, kind) in enumerate(zip(self.pieces, self.kinds.tolist(), strict=True)):
                table[i] = (
                    bytes([int(piece[1:-1], 16)]) if kind == BYTE
                    else b"" if kind == CONTROL
                    else " ⁇ ".encode() if kind == UNKNOWN
                    else piece.replace(BLANK, " ").encode()
                )
            self.__dict__["_table"] = table
        return table


def by_length(words: list[str], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of words, their code points) for words of one length each, about ``most`` characters at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(lengths[lengths > 0]).tolist():
        group = np.flatnonzero(lengths == size)
        step = max(1, most // size)
        for at in range(0, len(group), step):
            part = group[at : at + step]
            codes = np.frombuffer("".join(words[i] for i in part.tolist()).encode("utf-32-le", "surrogatepass"), "<u4")
            yield part, codes.reshape(len(part), size)


def _hash_text(piece: str) -> int:
    total = power = 0
    power = 1
    for c in piece:
        total = (total + (ord(c) + 1) * power) % 2**64
        power = power * _FACTOR % 2**64
    return total


@lru_cache(maxsize=4)
def load_model(path: str) -> PieceModel:
    return PieceModel.read(path)


class Encoder:
    """Texts to ids in a Python worker: words seen before are looked up, new ones encoded together."""

    def __init__(self, model: PieceModel, most: int = CACHE_WORDS):
        self.model, self.most, self.known, self.cut = model, most, {}, model.cutter.findall

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian int32 ids of each text."""
        cut = [self.cut((" " * self.model.prefix + t).replace(" ", BLANK)) if t else [] for t in texts]
        known = self.known
        new = list({w for words in cut for w in words if w not in known})
        if len(known) + len(new) > self.most:
            known.clear()
            new = list({w for words in cut for w in words})
        known.update(zip(new, self.model.encode_words(new), strict=True))
        return [b"".join([known[w] for w in words]) for words in cut]


def _piecewise(model, digest: bool, keep: int):
    """Batches of columns with the text last: the text becomes ids, or their digest after a round trip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for whole in batches:
            for batch in slices(whole, whole.schema.names[keep], SLICE_BYTES):
                texts = batch.column(keep).to_pylist()
                found = encoder.encode(texts)
                if digest:
                    same = [model.value.decode(np.frombuffer(x, "<i4")) == (t or "") for x, t in zip(found, texts, strict=True)]
                    columns = [
                        pa.array([len(x) // 4 for x in found], pa.int64()), pa.array([zlib.crc32(x) for x in found], pa.int64()), pa.array(same)
                    ]
                else:
                    ends = np.cumsum([0, *[len(x) // 4 for x in found]]).astype(np.int32)
                    columns = [pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(found), "<i4")))]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:keep], *columns], [*batch.schema.names[:keep], *[f"x{i}" for i in range(len(columns))]]
                )

    return run


def encode(docs: DataFrame, model: PieceModel, text: str = "text", ids: str = "piece_ids") -> DataFrame:
    """``docs`` with the array of piece ids of every whole text (``ids`` is lengthened if it is taken)."""
    names = docs.columns
    plain = docs.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)], col(text).cast("string").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one vocabulary file: a few MB
    kinds = ", ".join([*[f"{c} {k}" for c, k in plain.dtypes[:-1]], "x0 array<int>"])
    return plain.mapInArrow(_piecewise(shared, False, len(names)), kinds).toDF(*names, fresh(ids, names))


def round_trip(docs: DataFrame, model: PieceModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as 32-bit numbers) and restored, for every row.

    ``restored``: decoding the ids gives the text again (an empty one for a null text).
    """
    plain = docs.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = f"doc_id {plain.dtypes[0][1]}, x0 bigint, x1 bigint, x2 boolean"
    found = plain.mapInArrow(_piecewise(shared, True, 1), kinds)
    return found.toDF("doc_id", "n_pieces", "ids_crc32", "restored")


def decode(encoded: DataFrame, model: PieceModel, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its piece ids; null ids give null."""
    names = encoded.columns
    position = names.index(ids)
    plain = encoded.select(*[col(c).alias(f"c{i}") for i, c in enumerate(names)])
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if not x.is_valid else shared.value.decode(np.asarray(x.values)) for x in batch.column(position)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "out"])

    kinds = ", ".join([*[f"{c} {k}" for c, k in plain.dtypes], "out string"])
    return plain.mapInArrow(run, kinds).toDF(*names, fresh(out, names))
