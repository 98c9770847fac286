"""Periodic runs against the definition in plain Python."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from __spark_entry__ import queries
from feedwatch.llm import runs
from tests.llm import brute
from tests.llm.data import documents, ordered, plain, rows

SF = "/root/testdata/sf0.001"


def listed(catcher: runs.SquareCatcher) -> list[tuple]:
    return list(zip(*[x.tolist() for x in catcher.runs()], strict=True))


def sequences(count: int):
    rng = random.Random(3)
    for _ in range(count):
        size, kinds = rng.randint(0, 90), rng.choice([1, 2, 2, 3])
        own = [rng.randint(0, kinds) for _ in range(size)] if rng.random() < 0.4 else []
        while len(own) < size:
            own += [rng.randint(0, kinds) for _ in range(rng.randint(1, 7))] * rng.randint(1, 9)
        yield own


def test_runs_by_definition():
    for own in sequences(600):
        catcher = runs.SquareCatcher()
        catcher.append(np.array(own, np.uint64))
        assert listed(catcher) == brute.runs(own), own


def test_words_one_by_one():
    """The same runs, and every run announced by a square of its period while it lasts."""
    for own in sequences(80):
        catcher, told = runs.SquareCatcher(), []
        for i, word in enumerate(own):
            told += [(i, *s) for s in zip(*[x.tolist() for x in catcher.append(np.array([word], np.uint64))], strict=True)]
        found = listed(catcher)
        assert found == brute.runs(own)
        for i, start, period in told:
            assert own[start : start + period] == own[start + period : start + 2 * period]
            assert start + 2 * period <= i + period  # told within a period of its end
        for start, length, period in found:
            assert any(p == period and start <= s < start + length and i < start + length for i, s, p in told)


@pytest.mark.parametrize("kind", ["one word", "long period", "nested", "two words", "thue-morse"])
def test_long_texts(kind):
    """Half a million words in under ten seconds, whatever repeats in them."""
    n = 1 << 19
    own = {
        "one word": np.zeros(n),
        "long period": np.arange(n) % 5000,
        "nested": np.tile(np.r_[np.zeros(1000), 1], n // 1001),
        "two words": np.random.default_rng(1).integers(0, 2, n),
        "thue-morse": np.array([bin(i).count("1") & 1 for i in range(n)]),
    }[kind].astype(np.uint64)
    began = time.perf_counter()
    catcher = runs.SquareCatcher()
    catcher.append(own)
    found = listed(catcher)
    assert time.perf_counter() - began < 10
    for start, length, period in found[:: max(1, len(found) // 50)]:
        part = own[start : start + length]
        assert length >= max(6, 4 * period) and (part[period:] == part[:-period]).all()
        assert start == 0 or own[start - 1] != own[start - 1 + period]
        assert start + length == len(own) or own[start + length] != own[start + length - period]
    want = {"one word": [(0, n, 1)], "long period": [(0, n, 5000)], "thue-morse": []}
    assert kind not in want or found == want[kind]
    if kind == "nested":
        size = n // 1001 * 1001
        assert found[0] == (0, 1000, 1) and (0, size, 1001) in found and len(found) == n // 1001 + 1


def awkward() -> list[tuple]:
    texts = ["a b " * 30, "x\n\tx x  x x\x0bx", " x x x x x ", "é é é é é é tail", "a b c " * 8 + "z " * 9 + "end", "  \n", "q" * 4000, "x x x x x x\u00a0x"]
    return [(9000 + i, t, "en", "a", len(t), "f", 1, 0.5, "w", None) for i, t in enumerate(texts * 2)]


def test_query_on_awkward_rows(spark, tmp_path):
    own = rows() + awkward()
    documents(spark, own).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries()["op12_runs"](spark, str(tmp_path))
    assert ordered(found.collect()) == ordered(brute.run_rows(plain(own)))


def test_query_on_table(spark):
    own = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 6000]
    want = {r[0]: r for r in brute.run_rows(own)}
    found = {r.doc_id: tuple(r) for r in queries()["op12_runs"](spark, SF).collect()}
    assert len(found) >= len(own) and all(found[k] == v for k, v in want.items())


def test_operator_keeps_columns(spark):
    docs = documents(spark, rows()).withColumnRenamed("lang", "Runs")
    found = runs.find_runs(docs)
    assert found.columns == [*docs.columns, "runs_", "collapsed", "n_words"]
    assert runs.find_runs(docs.limit(0)).count() == 0
    for r in found.collect():
        own = brute.words(r.text)
        assert [tuple(x) for x in r.runs_] == brute.runs(own) and r.n_words == len(own)
        gone = {i for s, n, q in brute.runs(own) for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(own) if i not in gone)
