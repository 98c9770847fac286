"""Texts cut into parts that tokenizers treat on their own, and ragged arrays gathered by part.

A text is cut before every blank that stands between a character other than a blank and one that is not white
space.  Byte-level BPE starts a new piece at such a blank, and no SentencePiece piece (of the models that ``pieces`` takes) reaches
over it, so a text's ids are those of its parts, and each different part has to be tokenized once only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A blank that is no cut: next to another, before other white space or a control character, first or last.
_ODD = r"^ | [\s\v\p{Z}\x{85}\x00-\x1f]| $"


def _careful(text: str) -> list[str]:
    """Parts, each without the blank it was cut at."""
    pieces = text.split(" ")
    out = pieces[:1]
    for piece in pieces[1:]:
        if piece and not piece[0].isspace() and piece[0] > " " and out[-1] and out[-1][-1] != " ":
            out.append(piece)
        else:
            out[-1] += " " + piece
    return out


def split_parts(texts: pa.Array, whole: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different parts, their numbers in the order of the texts, and where each text's parts begin (and the end).

    Each part but a text's first comes without the one blank it was cut at.  Null and empty texts have no parts; the texts
    that ``whole`` marks are one part each.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()).fill_null("")
    odd = pc.match_substring_regex(texts, _ODD)
    lists = pc.split_pattern(texts, " ")
    odd = odd.to_numpy(zero_copy_only=False)
    whole = np.zeros(len(texts), bool) if whole is None else whole
    number = np.flatnonzero(odd | whole)
    if len(number):
        some = zip(texts.take(pa.array(number)).to_pylist(), whole[number].tolist(), strict=True)
        own = pa.array([[t] if one else _careful(t) for t, one in some], lists.type)
        places = np.arange(len(texts))
        places[number] = len(texts) + np.arange(len(number))
        lists = pa.concat_arrays([lists, own]).take(pa.array(places))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    parts = lists.flatten()
    if empty.any():
        parts = parts.filter(pa.array(np.repeat(~empty, counts)))
        counts[empty] = 0
    coded = parts.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(counts)])


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``values[start : start + size]`` of all pairs, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


def totals(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring places of ``at``."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[at[1:]] - sums[at[:-1]]
