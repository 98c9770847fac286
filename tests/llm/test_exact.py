"""Operators against their brute-force versions, on awkward rows, on a test table and on an empty one."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedwatch.llm import host_rules, mixing, pieces, simhash, substring, token_store
from feedwatch.llm.components import star_roots
from feedwatch.llm.perfect_hash import PerfectHash
from feedwatch.llm.queries import ORACLES, QUERIES, public_file
from tests.llm import brute
from tests.llm.data import documents, ordered, plain, rows
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def table_rows(table):
    return [(r.doc_id, r.text, r.source) for r in table.collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None


def test_simhash_awkward(spark):
    found = simhash.simhash_components(documents(spark)).collect()
    assert ordered(found) == ordered(brute.simhash(plain(rows())))


def test_simhash_table(spark, table_rows):
    assert ordered(QUERIES["op2_simhash"](spark, SF).collect()) == ordered(brute.simhash(table_rows))


def test_triples_cover():
    triples = simhash.covering_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


@pytest.mark.parametrize("most", [2048, 3])
def test_simhash_links(spark, most):
    """Balls of near fingerprints: the plain lists, and (with lists of three) the way over midpoints."""
    rng = np.random.default_rng(most)
    fps = []
    for centre in rng.integers(0, 2**63, 6).tolist():
        for _ in range(12):
            fps.append(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)))
    fps = list(dict.fromkeys([*fps, *rng.integers(0, 2**63, 40).tolist()]))
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    marked = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id bigint, fp bigint")
    found = {r.fp: r.component_id for r in simhash.near_duplicates(marked, most=most).collect()}
    assert [found[f] for f in signed] == brute.components(fps)


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100)] + [(200 + int(x), 200 + int(y)) for x, y in rng.integers(0, 60, (50, 2))]
    roots = {r.node: r.root for r in star_roots(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    parent = {x: x for p in pairs for x in p}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    assert roots == {x: top(x) for x in parent if top(x) != x}


def test_simhash_dedup(spark):
    own = rows()
    kept = simhash.simhash_dedup(documents(spark))
    assert kept.columns == documents(spark).columns
    roots = brute.components([brute.fingerprint(r[1]) for r in own])
    want = Counter(min((brute.order(r[0]) for r, o in zip(own, roots, strict=True) if o == g)) for g in set(roots))
    assert Counter(brute.order(r.doc_id) for r in kept.collect()) == want


def test_rules(spark, table, table_rows):
    for docs, own in ((documents(spark), plain(rows())), (table, table_rows)):
        judged = host_rules.judge(docs, carry=["doc_id"])
        found = [
            (r.doc_id, *[r.fw_rules[m] for m in host_rules.MEASURES], r.fw_rules.base_failed) for r in judged.collect()
        ]
        assert ordered(found) == ordered([(d, *brute.rules(t)) for d, t, _ in own])


def test_host_verdict(spark):
    """A host that fails as a rule takes its good documents along; a few failures elsewhere do not."""
    good, bad = "a b c d e f g h i j k l m n o p q r s t u v", "too short"
    own = [(i, good if i % 10 == 0 else bad, "en", "spam", 1, "", 0, 0.0, "", 0) for i in range(200)]
    own += [(1000 + i, bad if i % 10 == 0 else good, "en", None, 1, "", 0, 0.0, "", 0) for i in range(200)]
    own += [(2000, good, "en", "tiny", 1, "", 0, 0.0, "", 0), (2001, bad, "en", "tiny", 1, "", 0, 0.0, "", 0)]
    kept = host_rules.keep_good(documents(spark, own))
    assert kept.columns == documents(spark).columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {1000 + i for i in range(200) if i % 10} | {2000}


def test_substring(spark, table, table_rows):
    for docs, own in ((documents(spark), plain(rows())), (table, table_rows)):
        want = ordered(brute.substring(own))
        assert sum(r[2] for r in want) > 0
        assert ordered(substring.repeated_words(docs).collect()) == want
    assert ordered(substring.repeated_words(documents(spark), chunk_bytes=400).collect()) == ordered(brute.substring(plain(rows())))


def test_drop_repeated(spark):
    found = substring.drop_repeated(documents(spark))
    assert found.columns == documents(spark).columns
    by_id = {r.doc_id: r.text for r in found.where("doc_id is not null").collect()}
    assert by_id[4] == rows()[4][1] and by_id[1] is None and by_id[2] == ""
    assert by_id[5] == " ".join(rows()[5][1].split()[70:])
    assert by_id[6] == " ".join(rows()[6][1].split()[:30])
    assert 7 in by_id and by_id[7] == rows()[9][1]  # the copies of 6 have nothing left


def test_mixing(spark, table, table_rows):
    for docs, own in ((documents(spark), plain(rows())), (table, table_rows)):
        sizes: Counter = Counter()
        for _, text, source in own:
            sizes[source] += len(brute.words(text))
        want = brute.targets(dict(sizes))
        plan = mixing.mix_plan(docs).collect()
        again = mixing.mix_plan(docs.repartition(5)).collect()
        assert Counter((r.id, r["size"], r.repeats) for r in plan) == Counter((r.id, r["size"], r.repeats) for r in again)
        assert len(plan) == len(own)
        taken: Counter = Counter()
        for r in plan:
            assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
            assert 0 <= r.repeats <= 2
            taken[r.source] += r.repeats * r["size"]
        for source, target in want.items():
            longest = max(r["size"] for r in plan if r.source == source)
            assert abs(taken[source] - target) <= longest / 2 + 1e-6


def test_water_filling_rounds(spark):
    """Sources that are clamped one after the other, one without words, one without weight."""
    sizes = {"a": 10, "b": 40, "c": 1000, "d": 0, "e": 100}
    weights = {"a": 5.0, "b": 2.0, "c": 1.0, "d": 9.0, "e": 0.0}
    frame = spark.createDataFrame([(s, sizes[s], weights[s]) for s in sizes], "source string, source_size bigint, weight double")
    found = {r.source: r.target for r in mixing.water_fill(frame, 1.0).collect()}
    assert found == {"a": 20.0, "b": 80.0, "c": pytest.approx(1050.0), "d": 0.0, "e": 0.0}


def test_mix_rows(spark):
    found = mixing.mix(documents(spark))
    assert found.columns == documents(spark).columns
    plan = Counter()
    for r in mixing.mix_plan(documents(spark)).collect():
        plan[r.id] += r.repeats
    assert Counter(r.doc_id for r in found.collect()) == +plan


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_file("byte_bpe_50k.json"))


def test_token_store_table(spark, table_rows, tokenizer):
    found = QUERIES["op1_token_store"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert ordered(found.collect()) == ordered(brute.token_rows(table_rows, tokenizer))


def test_token_store_awkward(spark, tokenizer):
    store = token_store.write_store(documents(spark), public_file("byte_bpe_50k.json"), shard_bytes=400)
    assert store.shards.count() > 3
    found = token_store.read_ids(store, store.rows.select("doc_id", "copy")).orderBy("start").collect()
    texts = {}
    for doc_id, text, _ in plain(rows()):
        ids = [*(tokenizer.encode(text, add_special_tokens=False).ids if text else []), 2]
        texts.setdefault(doc_id, []).append(ids)
    assert [brute.order(r.doc_id) for r in found] == sorted(brute.order(r[0]) for r in rows())
    for doc_id, all_ids in texts.items():
        own = [r for r in found if r.doc_id == doc_id]
        assert sorted(r.copy for r in own) == list(range(len(all_ids)))
        assert sorted(r.ids for r in own) == sorted(all_ids)
    ends = [r.start + r.n_tokens for r in found]
    assert [r.start for r in found] == [0, *ends[:-1]]
    asked = spark.createDataFrame([(4, 0), (7, 2), (7, 3), (777, 0), (None, 1)], "doc_id bigint, copy int")
    assert {(r.doc_id, r.copy) for r in token_store.locate(store, asked).collect()} == {(4, 0), (7, 2), (None, 1)}


@pytest.mark.parametrize("shared", [1, 3])
def test_token_store_equal_hashes(spark, monkeypatch, shared):
    """Keys with the same 64-bit hash are found by their second one."""
    hashes = token_store._key_hashes
    few = lambda *names: [F.pmod(hashes()[0], F.lit(shared)).cast("bigint").alias("h"), hashes()[1]]
    monkeypatch.setattr(token_store, "_key_hashes", few)
    store = token_store.write_store(documents(spark), public_file("byte_bpe_50k.json"))
    found = {(r.doc_id, r.copy): (r.shard, r.place, r.n) for r in token_store.locate(store, store.rows.select("doc_id", "copy")).collect()}
    assert found == {(r.doc_id, r.copy): (r.shard, r.place, r.n) for r in store.rows.collect()}
    foreign = spark.createDataFrame([(777, 0), (4, 9)], "doc_id bigint, copy int")
    assert token_store.locate(store, foreign).count() == 0


def test_words_at_odd_blanks(tokenizer):
    encoder = token_store.WordwiseEncoder(public_file("byte_bpe_50k.json"), most=5)
    texts = ["  a  b \n c\t d's  'll <|endoftext|>  x　z\x1c q \x1f r s\x85 v  ", " ", "\n", " x", "a", "0 1", "x " * 50, " \n\n  y"]
    texts += ["  a  b \n c\t d's  'll   x　z\x1c q \x1f r s\x85 v  ", "hello <|endoftext|> world", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "<|endoftext", "a\x00b \x00c"]
    for _ in range(3):
        ids, at = encoder.encode(pa.array([*texts, None]))
        found = [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
        assert found == [*[tokenizer.encode(t, add_special_tokens=False).ids for t in texts], []]
    assert found[texts.index("hello <|endoftext|> world")] == [31373, 220, 50256, 995]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    found, used = PerfectHash.from_bytes((raw := PerfectHash.build(keys).to_bytes()) + b"more")
    assert used == len(raw) and len(found) == len(keys)
    assert sorted(found.find(keys).tolist()) == list(range(len(keys)))
    twins = PerfectHash.build(np.concatenate([keys, keys[:1]]))
    assert len(twins.rest) == (2 if len(keys) else 0)


def test_pieces_equal_library(spark, table_rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_file("piece_bpe_32k.model"))
    model = pieces.load_model(public_file("piece_bpe_32k.model"))
    own = [r[1] for r in table_rows] + [r[1] for r in rows() if r[1] is not None]
    own += ["  a  b\n c ", "日本語 テスト 🙂🙂 á", "x" * 300 + " " * 40 + "y", "thethethe  the▁the"]
    encoder = pieces.Encoder(model, most=2000)
    found = [np.frombuffer(x, "<i4") for i in range(0, len(own), 50) for x in encoder.encode(own[i : i + 50])]
    assert [x.tolist() for x in found] == library.encode(own)
    assert [model.decode(x) for x in found] == [t.replace("▁", " ") for t in own]


def test_unigram_is_best_path():
    """A unigram model's path is the best of all segmentations (ties aside)."""
    vocabulary = {"▁": -3.0, "a": -2.5, "b": -2.6, "▁a": -2.0, "ab": -3.1, "ba": -3.3, "▁ab": -4.7, "aba": -6.0, "bb": -4.4}
    model = pieces.PieceModel(["<unk>", *vocabulary], [0.0, *vocabulary.values()], [2] + [1] * len(vocabulary), pieces.UNIGRAM)

    def best(word: str) -> float:
        scores = [0.0]
        for end in range(1, len(word) + 1):
            scores.append(max(scores[i] + vocabulary[word[i:end]] for i in range(end) if word[i:end] in vocabulary))
        return scores[-1]

    words = ["▁" + "".join(x) for n in range(6) for x in __import__("itertools").product("ab", repeat=n)]
    for word, ids in zip(words, model.encode_words(words), strict=True):
        own = [model.pieces[i] for i in np.frombuffer(ids, "<i4")]
        assert "".join(own) == word and sum(vocabulary[p] for p in own) == pytest.approx(best(word))


def test_encode_decode(spark):
    model = pieces.load_model(public_file("piece_bpe_32k.model"))
    docs = documents(spark)
    back = pieces.decode(pieces.encode(docs, model), model)
    assert back.columns == [*docs.columns, "piece_ids", "decoded"]
    for r in back.collect():
        assert r.decoded == (r.text or "")
    assert all(r.restored for r in QUERIES["op9_pieces"](spark, SF).collect())


def test_empty_tables(spark):
    none = documents(spark, [])
    assert simhash.simhash_components(none).count() == 0
    assert simhash.simhash_dedup(none).count() == 0
    assert host_rules.keep_good(none).count() == 0
    assert substring.repeated_words(none).count() == 0
    assert substring.drop_repeated(none).count() == 0
    assert mixing.mix(none).count() == 0
    model = pieces.load_model(public_file("piece_bpe_32k.model"))
    assert pieces.encode(none, model).count() == 0
    store = token_store.write_store(none, public_file("byte_bpe_50k.json"))
    assert token_store.read_ids(store, store.rows.select("doc_id", "copy")).count() == 0
