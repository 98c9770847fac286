"""Alignment of two tokenizers against the libraries on whole texts and all pairs of byte ranges."""

from __future__ import annotations

import random
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from __spark_entry__ import queries
from feedwatch.llm import align
from feedwatch.llm.queries import public_file
from feedwatch.llm.wordwise import split_parts
from tests.llm import brute
from tests.llm.data import documents, ordered, plain, rows

SF = "/root/testdata/sf0.001"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_file(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_file(B))


def awkward() -> list[tuple]:
    texts = [
        " ", "  ", " a", "a ", "a  b", "a   b \n c", "\n", "\t x", "a\n\n b", "a \tb", "x \u00a0y", "x \u3000 y", "\u2581", "a \u2581b", "</s> <s>",
        "hello <|endoftext|> world", "<|endoftext|>", "a\x00b \x00c", "\x1f d \x1f", "e\u0301 \ufb01 \u2460", "日本語 テキスト", "🙂 🙂🙂",
        "don't we'll I'd", "1234567 89", "a" * 3000, "the the the", "x \x85 y", "\u200b z",
    ]
    return [(9000 + i, t, "en", "a", len(t), "f", 1, 0.5, "w", None) for i, t in enumerate(texts * 2)]


def test_groups_and_links():
    """Every cut of both sides, and links by all pairs of ranges."""
    rng = random.Random(2)
    for _ in range(500):
        n = rng.randint(1, 14)
        sides = []
        for _ in range(2):
            cuts = [0, *sorted(rng.sample(range(1, n), rng.randint(0, n - 1))), n]
            sides.append(list(zip(cuts, cuts[1:], strict=False)))
        a_cuts, b_cuts, links = align.align(*[np.array([e - s for s, e in side]) for side in sides])
        a, b = sides
        assert [tuple(x) for x in links.tolist()] == [(i, j) for i, (s, e) in enumerate(a) for j, (t, f) in enumerate(b) if max(s, t) < min(e, f)]
        common = sorted({e for _, e in a} & {e for _, e in b})
        assert [a[i - 1][1] for i in a_cuts] == common == [b[i - 1][1] for i in b_cuts]


def test_parts_join_to_texts(libraries):
    """Ids of parts, one after the other, are the libraries' ids of the whole text."""
    a, b = libraries
    own = [r[1] for r in rows() + awkward()]
    parts, index, at = split_parts(pa.array(own))
    parts = parts.to_pylist()
    for k, text in enumerate(own):
        cut = [parts[i] for i in index[at[k] : at[k + 1]]]
        assert " ".join(cut) == (text or "")
        if text:
            assert [i for p in cut for i in a.encode(" " + p, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids
            assert [i for p in cut for i in b.encode(p)] == b.encode(text)


def test_query_on_awkward_rows(spark, tmp_path, libraries):
    own = rows() + awkward()
    documents(spark, own).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["op13_alignment"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(found.collect()) == ordered(brute.alignment_rows(plain(own), *libraries))


def test_query_on_table(spark, libraries):
    own = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = {r.doc_id: tuple(r) for r in queries()["op13_alignment"](spark, SF).collect()}
    want = {r[0]: r for r in _fast_rows(own, *libraries)}
    assert found == want


def _fast_rows(own, a, b):
    """As the brute-force version, with ranges met by walking over whole texts."""
    short = [r for r in own if len(r[1] or "") < 500]
    slow = dict(zip([r[0] for r in short], [brute.aligned(t, a, b)[3] for _, t, _ in short], strict=True))
    aligned = brute.aligned
    table = brute.byte_level()

    def walked(text, a, b):
        if not text:
            return [], [], [], []
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_bytes = [bytes(table[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in b_ids]
        if b"".join(b_bytes) != (" " + text).encode():
            return [], [], [], []
        owner = [j for j, x in enumerate(b_bytes) for _ in x]
        links, groups, at, left, right = [], [], 0, [], []
        ends = set(accumulate(map(len, b_bytes)))
        begin = 0
        for i, x in zip(a_ids, a_bytes, strict=True):
            links += [(i, b_ids[j]) for j in sorted(set(owner[at : at + len(x)]))]
            at += len(x)
            left.append(i)
            if at in ends:
                groups.append((left, [b_ids[j] for j in sorted(set(owner[begin:at]))]))
                left, begin = [], at
        return a_ids, b_ids, groups, links

    for doc_id, text, _ in short:
        assert walked(text, a, b)[3] == slow[doc_id]
    brute.aligned = walked
    try:
        return brute.alignment_rows(own, a, b)
    finally:
        brute.aligned = aligned


def test_small_chunks_and_caches(spark, libraries, monkeypatch):
    """The figures do not depend on how texts are packed; the operator keeps columns and gives the groups themselves."""
    own = rows() + awkward()
    docs = documents(spark, own).withColumnRenamed("lang", "Groups")
    monkeypatch.setattr(align, "CHUNK_BYTES", 200)
    found = align.align_tokenizers(docs, public_file(A), public_file(B))
    assert found.columns == [*docs.columns, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_"]
    want = {(r[0], r[1]): r for r in brute.alignment_rows(plain(own), *libraries)}
    for r in found.collect():
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want[r.doc_id, r.n_a][1:7]
        assert r.groups_.count(";") == max(0, r.n_groups - 1) and r.groups_.count("|") == r.n_groups
    assert align.align_tokenizers(docs.limit(0), public_file(A), public_file(B)).count() == 0


def test_parts_one_by_one(libraries, monkeypatch):
    """Parts give the same joined in blocks of any size, in any order."""
    parts = list(dict.fromkeys(p for r in rows() + awkward() if r[1] for p in _parts(r[1])))
    random.Random(4).shuffle(parts)
    for joined in (1, 3, 500):
        monkeypatch.setattr(align, "JOINED", joined)
        found = align.PartAligner(public_file(A), public_file(B)).align(parts)
        for i, part in enumerate(parts):
            if part == "":  # a text that begins with blanks has no such part of its own in the brute-force version
                continue
            a, b, groups, links = brute.aligned(part, *libraries)
            assert found.kept[i] == bool(a)
            assert (found.n_a[i], found.n_b[i], found.n_groups[i], found.n_links[i]) == (len(a), len(b), len(groups), len(links))
            text = "".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) + ";" for x, y in groups)
            assert found.texts[i].as_py().decode() == text
            at = int(found.n_links[:i].sum())
            assert found.pairs[at : at + len(links)].tolist() == [x << 32 | y for x, y in links]


def _parts(text):
    parts, index, at = split_parts(pa.array([text]))
    return parts.to_pylist()
