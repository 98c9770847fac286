"""MinHash near-duplicates against all pairs of shingle sets in plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from __spark_entry__ import queries
from feedwatch.llm import minhash
from tests.llm import brute
from tests.llm.data import SCHEMA, documents, ordered, plain, prose, rows

SF = "/root/testdata/sf0.001"


def shingles(text) -> set:
    words = brute.words(brute.lower(text or ""))
    return {tuple(words)} - {()} if len(words) < 4 else {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def component_rows(own) -> list[tuple]:
    sets, root = [shingles(t) for _, t, _ in own], list(range(len(own)))
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                shared[j] += 1
        for j, n in shared.items():
            if j < i and 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _, _) in enumerate(own):
        if doc_id is not None:
            least[find(i)].append(doc_id)
    out = []
    for i, (doc_id, _, _) in enumerate(own):
        low = min(least[find(i)], default=None)
        out.append((doc_id, len(sets[i]), low, doc_id == low))
    return out


def changed(words: list[str], at) -> str:
    return " ".join(f"new{i}x{len(at)}" if i in at else w for i, w in enumerate(words))


def near() -> list[tuple]:
    """Copies around 0.8, a pair of exactly 0.8, a chain, a passage that many share, a large group of wide spread."""
    rng, out = random.Random(5), []
    for k in range(30):
        words = prose(200, 1000 + k).split()
        out.append((100 + 10 * k, " ".join(words)))
        for n, places in enumerate(([90], [40, 140], [30, 90, 150], [30, 90, 130, 170], [20, 60, 100, 140, 180], [20, 50, 80, 110, 140, 170])):
            out.append((101 + 10 * k + n, changed(words, places)))
    words = prose(39, 8).split()  # 36 shingles; one changed word inside takes four: 32 of 40
    out += [(500, " ".join(words)), (501, changed(words, [18]))]
    words = prose(120, 9).split()
    for k in range(12):  # a chain: each is near the next, the ends are far apart
        out.append((600 + k, " ".join(words)))
        at = 8 * k + 5
        words = words[:at] + [f"turn{k}"] + words[at + 1 :]
        words[at + 4] = f"turned{k}"
    passage = prose(30, 31)
    out += [(1000 + n, prose(rng.randint(20, 60), 2000 + n) + " " + passage) for n in range(200)]
    words = prose(120, 77).split()
    out += [(2000 + n, changed(words, rng.sample(range(120), rng.choice([1, 2, 3, 6, 10, 20])))) for n in range(400)]
    return [(i, t, "en", "a", len(t), "f", 1, 0.5, "w", None) for i, t in out]


@pytest.mark.parametrize("most", [minhash.MOST, 30_000])
def test_components(spark, most):
    """Equal whether sets that hang together fit into one task or their lists do."""
    own = near() + rows()
    found = minhash.minhash_components(spark.createDataFrame(own, SCHEMA).repartition(3), most=most)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    want = ordered(component_rows(plain(own)))
    assert ordered(tuple(r) for r in found.collect()) == want
    sizes = defaultdict(int)
    for r in want:
        sizes[r[2]] += 1
    assert sizes[500] == 2 and sizes[600] == 12 and max(sizes.values()) > 150


def test_lists_too_large_for_a_task(spark):
    """Lists whose members are compared with one after the other, in rounds, give the same."""
    rng = random.Random(6)
    words = prose(60, 78).split()
    own = [(i, changed(words, rng.sample(range(60), rng.choice([1, 2, 3, 4])))) for i in range(14)]
    own = [(i, t, "en", "a", len(t), "f", 1, 0.5, "w", None) for i, t in own]
    found = minhash.minhash_components(spark.createDataFrame(own, SCHEMA), most=100)
    assert ordered(tuple(r) for r in found.collect()) == ordered(component_rows(plain(own)))


def test_query_on_table(spark):
    own = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert ordered(tuple(r) for r in queries()["op11_minhash"](spark, SF).collect()) == ordered(component_rows(own))


def test_no_rows(spark):
    assert minhash.minhash_components(documents(spark, [])).count() == 0
    blank = [(i, t, "en", "a", 0, "f", 1, 0.5, "w", None) for i, t in enumerate([None, "", " \n"])]
    found = minhash.minhash_components(documents(spark, blank)).collect()
    assert sorted(tuple(r) for r in found) == [(i, 0, i, True) for i in range(3)]


def test_pairs_within_the_distance_meet():
    """Any signatures that differ in fewer than two symbols a chunk share a key, as the pigeonhole says."""
    rng = np.random.default_rng(1)
    size = minhash.CHUNKS * minhash.SYMBOLS
    for _ in range(300):
        a = rng.integers(0, 1 << 16, size).astype(np.uint16)
        b = a.copy()
        b[rng.choice(size, 2 * minhash.CHUNKS - 1, replace=False)] ^= np.uint16(1)
        one, two = minhash.index_keys(np.stack([a, b]))
        assert set(one) & set(two)
        assert not set(one) & set(minhash.index_keys(rng.integers(0, 1 << 16, (1, size)).astype(np.uint16))[0])
    assert minhash.miss(0.8) < 4e-7 and minhash.miss(1.0) == 0


def test_symbols_agree_as_often_as_sets():
    rng = np.random.default_rng(2)
    for shared in (80, 400, 900):
        agree = []
        for _ in range(40):
            own = rng.integers(0, 1 << 63, 2000 - shared).astype(np.uint64)
            a, b = own[:1000], np.concatenate([own[:shared], own[1000:]])
            agree.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(agree) - shared / (2000 - shared)) < 0.03


def test_groups_by_their_links():
    """One group with its components given: links join exactly what all pairs join."""
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64))
    sets = [np.sort(np.concatenate([rng.choice(base, 54, replace=False), rng.integers(0, 1 << 63, k).astype(np.uint64)])) for k in rng.integers(0, 9, 40)]
    roots = rng.integers(0, 8, 40)
    table = pa.table({"node": np.arange(40), "root": roots, "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    links = minhash._solve(table)

    def joined(pairs):
        group = roots.copy()
        for a, b in pairs:
            group[group == group[a]] = group[b]
        return [min(np.flatnonzero(group == g)) for g in group]

    every = [(i, j) for i in range(40) for j in range(i) if minhash.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
    assert joined(zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True)) == joined(every)
    assert len(links) < len(every)
