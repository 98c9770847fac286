"""Learnt operators: against brute force where they can be, else by held-out accuracy; nearest neighbours by recall."""

from __future__ import annotations

import math
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from feedwatch.llm import ann, lattice_lm, pieces, quality, toxicity
from feedwatch.llm.labels import labelled_sample
from feedwatch.llm.queries import QUERIES, public_file
from tests.llm import brute
from tests.llm.data import documents, plain, rows

SF = "/root/testdata/sf0.01"


def lattice(vocabulary: dict[str, float]) -> lattice_lm.Lattice:
    names = ["<unk>", *[f"<0x{i:02X}>" for i in range(256)], *vocabulary]
    model = pieces.PieceModel(names, [0.0] * len(names), [2] + [6] * 256 + [1] * len(vocabulary), pieces.UNIGRAM)
    logs = np.log([1e-300, *[1e-4] * 256, *vocabulary.values()])
    return lattice_lm.Lattice(model, logs)


def segmentations(word: str, vocabulary: dict[str, float]):
    if not word:
        yield [], 1.0
    for n in range(1, len(word) + 1):
        p = vocabulary.get(word[:n], 1e-4 ** len(word[0].encode()) if n == 1 else None)
        if p is not None:
            for rest, q in segmentations(word[n:], vocabulary):
                yield [word[:n], *rest], p * q


def test_lattice_sums_all_segmentations():
    vocabulary = {"▁": 0.1, "a": 0.2, "b": 0.1, "▁a": 0.05, "ab": 0.07, "aba": 0.01, "ba": 0.03}
    own = lattice(vocabulary)
    words = ["", "a", "ab", "abab", "bbb", "aéb", "abaé"]
    found = own.log_probabilities(words)
    counts = own.expected_counts(words, np.arange(1.0, len(words) + 1))
    want = Counter()
    for word, times, log in zip(words, range(1, len(words) + 1), found, strict=True):
        every = list(segmentations("▁" + word, vocabulary))
        total = sum(p for _, p in every)
        assert log == pytest.approx(math.log(total))
        for cut, p in every:
            for piece in cut:
                want[piece] += times * p / total
    for piece in vocabulary:
        assert counts[own.model.pieces.index(piece)] == pytest.approx(want[piece], abs=1e-5)
    assert counts[own.model.by_byte["é".encode()[0]]] == pytest.approx(want["é"], rel=1e-5)


def check_scores(found, own):
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = [(d, [brute.lower(w) for w in brute.words(t)] + [None]) for d, t, _ in own]
    counts = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (d is None, d or 0, held(d), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        for d, ws in tokens
    )
    rows_ = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found)
    assert len(rows_) == len(want)
    for a, b in zip(rows_, want, strict=True):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], rel=1e-9)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_lattice_scores(spark):
    model = pieces.load_model(public_file("piece_bpe_32k.model"))
    check_scores(lattice_lm.lattice_scores(documents(spark), model).collect(), plain(rows()))
    assert lattice_lm.lattice_scores(documents(spark, []), model).count() == 0
    # Only held-out rows: nothing is known.
    only = [(d, "ab Ab c", "en", "s", 1, "", 0, 0.0, "", 0) for d in range(40) if zlib.crc32(str(d).encode()) % 5 == 1]
    check_scores(lattice_lm.lattice_scores(documents(spark, only), model).collect(), plain(only))


def test_lattice_table(spark):
    found = QUERIES["op5_lattice_lm"](spark, SF).collect()
    own = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_scores(found, own)


def test_word_probabilities_sum_to_one():
    shares = lattice_lm.Shares(words=90, ends=10, types=30, once=9)
    seen = shares.log10(np.array([60.0, 30.0]), np.log([1e-300, 1e-300]))
    new = shares.log10(np.zeros(2), np.log([0.25, 0.75]))
    assert sum(10**x for x in [*seen, *new, math.log10(shares.end)]) == pytest.approx(1.0)


def accuracy(found, labels, name):
    held = [(r.predicted, labels[r.doc_id][name]) for r in found if r.held_out and r.doc_id in labels]
    return sum(a == b for a, b in held) / len(held)


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality(spark, labels):
    found = QUERIES["op4_quality"](spark, SF).collect()
    assert len(found) == 1000 and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert accuracy(found, labels, "quality") > 0.95


def test_toxicity(spark, labels):
    found = QUERIES["op6_toxicity"](spark, SF).collect()
    assert len(found) == 1000 and all(0 <= r.score <= 1 for r in found)
    assert accuracy(found, labels, "toxic") > 0.93


def test_fold():
    assert toxicity.fold_text("St­UPіD, 1D10T!") == toxicity.fold_text("stupid idiot")
    assert toxicity.fold_text("ｓｔｕｐｉｄ l0ser") == toxicity.fold_text("STUPID loser")
    assert toxicity.fold_text(None) == toxicity.fold_text("") == toxicity.fold_text(" .,") == " "


def test_exceptions():
    lexicon = toxicity.Lexicon({" trash ": 3.0, " tras": 1.0}, [" trash can "])
    own = lexicon.automaton()
    assert toxicity.matches(own, " you trash ") == {4: 3.0}
    assert toxicity.matches(own, " the trash can is trashy ") == {17: 1.0}
    assert toxicity.features(own, " ") == (0.0, 0.0)
    assert toxicity.matches(toxicity.Lexicon().automaton(), " a ") == {}


def test_learns_exceptions(spark):
    own = [(i, f"some words here you trash person {i}" if i % 2 else f"put it in the trash can now {i}", i % 2) for i in range(80)]
    lexicon = toxicity.learn(spark.createDataFrame(own, "id bigint, text string, label int"))
    assert lexicon.weights and len(lexicon.automaton())


@pytest.mark.parametrize("what", [quality.quality, toxicity.toxicity])
def test_classifier_edges(spark, what):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    some = spark.createDataFrame([(0, 1, 0), (0, None, 1), (4, 0, 1), (None, 1, 1), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    for marks in (none, some):
        found = what(documents(spark), marks).collect()
        assert len(found) == len(rows()) and all(0 <= r.score <= 1 and r.held_out is not None for r in found)
        assert what(documents(spark, []), marks).count() == 0


def brute_nearest(own: list[tuple], every: int = 50, top: int = 5) -> dict:
    """Only rows that take part: (vec_id, list)."""
    ids, matrix = np.array([r[0] for r in own]), np.array([r[1] for r in own], float)
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        sims = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -np.round(sims, 12))) if j != i][:top]
        out[int(ids[i])] = [(int(ids[j]), float(sims[j])) for j in order]
    return out


def recall(found, want) -> float:
    got: dict = {}
    for r in found:
        got.setdefault(r.query_id, []).append(r.vec_id)
    return sum(len({v for v, _ in pairs} & set(got.get(q, []))) for q, pairs in want.items()) / sum(map(len, want.values()))


def test_nearest_table(spark):
    own = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = QUERIES["op10_nn_descent"](spark, SF).orderBy("query_id", "rank").collect()
    want = brute_nearest(own)
    assert len(found) == 5 * len(want) and recall(found, want) >= 0.9
    exact = {(q, v): s for q, pairs in want.items() for v, s in pairs}
    assert all(r.score == pytest.approx(exact[r.query_id, r.vec_id], abs=1e-12) for r in found if (r.query_id, r.vec_id) in exact)


def test_nearest_awkward(spark):
    """Copies beyond the top, bad vectors, repeated rows, other lengths, a few candidates only."""
    rng = np.random.default_rng(3)
    good = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    copy = rng.normal(size=8).tolist()
    good += [(i, copy) for i in range(300, 400)] + [(400, [2 * x for x in copy])]
    bad = [(1000, None), (1050, [0.0] * 8), (1100, [1.0] * 7 + [None]), (1150, [math.nan] * 8), (1200, [math.inf] + [0.0] * 7), (1250, [1.0] * 3), (None, copy)]
    frame = spark.createDataFrame([(a, b, "x") for a, b in [*good, *bad, good[0], good[350]]], "vec_id bigint, embedding array<double>, node string")
    found = ann.nearest(frame).orderBy("query_id", "rank").collect()
    want = brute_nearest(good)
    assert len(found) == 5 * len(want) and recall(found, want) >= 0.9
    by_query = {q: [r.vec_id for r in found if r.query_id == q] for q in want}
    assert by_query[350] == [300, 301, 302, 303, 304]
    assert by_query[300] == [301, 302, 303, 304, 305]
    few = ann.nearest(frame.where("vec_id in (0, 1, 2, 1000)")).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 1), (0, 2)]
    assert ann.nearest(frame.where("vec_id = 0")).count() == 0
    assert ann.nearest(frame.where("vec_id < 0")).count() == 0


def test_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    own = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert recall(ann.nearest(frame).collect(), brute_nearest(own)) >= 0.9


@pytest.mark.parametrize("noise", [0.01, 0.0001])
def test_nearest_among_near_copies(spark, noise):
    """A third of all rows are copies of one vector with little noise; leaves and hubs hold thousands of them."""
    rng = np.random.default_rng(4)
    centre = rng.normal(size=64)
    copies = centre + rng.normal(size=(3000, 64)) * noise * np.linalg.norm(centre) / 8
    rest = rng.normal(size=(1500, 64))
    own = [(i, v.tolist()) for i, v in enumerate(np.concatenate([copies, rest]))]
    frame = spark.createDataFrame(own, "vec_id bigint, embedding array<double>")
    assert recall(ann.nearest(frame).collect(), brute_nearest(own)) >= 0.9


def test_large_groups_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(ann, "TASK_NODES", 100)
    own = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert recall(ann.nearest(spark.read.parquet(f"{SF}/embeddings.parquet")).collect(), brute_nearest(own)) >= 0.9


def test_phrases_in_a_long_text():
    """Words within exception phrases by the definition, and a megabyte of them in seconds."""
    lexicon = toxicity.Lexicon({" bad ": 1.0, " ba": 0.5, " worse ": 2.0}, [" not bad ", " bad luck ", " far worse "])
    automaton = lexicon.automaton()
    rng = np.random.default_rng(6)
    for _ in range(200):
        words = rng.choice(["bad", "not", "luck", "worse", "far", "bath", "x"], 30)
        folded = " " + " ".join(words) + " "
        spared = [(m, m + len(p) - 1) for p in lexicon.exceptions for m in range(len(folded)) if folded.startswith(p, m)]
        want = {}
        for entry, weight in lexicon.weights.items():
            for at in range(len(folded)):
                if folded.startswith(entry, at) and not any(a <= at < b for a, b in spared):
                    want[at] = max(want.get(at, 0), weight)
        assert toxicity.matches(automaton, folded) == want
    began = time.perf_counter()
    assert toxicity.matches(automaton, " not bad" * 130_000 + " ") == {}
    assert time.perf_counter() - began < 10


def test_sample_is_bounded_in_rows_and_bytes(spark):
    """An id in very many rows is one row of the sample; texts past the bound on bytes are left out."""
    docs = spark.createDataFrame([(i, "t" * 100 + str(i)) for i in range(300)] + [(7, f"x{n}") for n in range(5000)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(7, 0)], "doc_id bigint, quality int")
    sample = labelled_sample(docs, marks, "quality", 3, 1)
    found = {r.id: (r.text, r.label) for r in sample.collect()}
    train = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(found) == train and sample.count() == len(train)
    assert 7 not in train or found[7] == ("t" * 100 + "7", 1)
    few = labelled_sample(docs, marks, "quality", 3, 1, most_bytes=1000)
    assert 9 <= few.count() <= 11 and {r.id for r in few.collect()} <= set(train)
    assert labelled_sample(docs, marks, "quality", 3, 1, rows=20).count() == 20
