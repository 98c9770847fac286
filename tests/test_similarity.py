from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedwatch.functions import vectors as vc
from feedwatch.operators import similarity as sim
from feedwatch.plans import similar as plan

ENTRY = "site string, pos bigint, title_vec array<double>, sent_vecs array<array<double>>"
TARGET = "site string, target_pos int, title_vec array<double>, sent_vecs array<array<double>>"


def cos(a, b):
    scale = np.linalg.norm(a) * np.linalg.norm(b)
    return 0.0 if scale == 0 else float(np.dot(a, b) / scale)


def brute(entries, targets, s):
    """The contract pair by pair."""
    found = {}
    for site, pos, title, sents in entries:
        for t_site, t_pos, t_title, t_sents in targets:
            if site != t_site:
                continue
            by_title = cos(title, t_title)
            score = None
            if sents and t_sents:
                best = sorted((max(cos(t, e) for e in sents) for t in t_sents), reverse=True)
                kept = best[: min(s.num_similar_sentences, len(sents), len(t_sents))]
                score = sum(kept) / len(kept)
            a, b = by_title > s.title_threshold, score is not None and score > s.sentence_threshold
            if (a and b) if s.use_and else (a or b):
                found[t_pos, pos] = (round(by_title, 6), None if score is None else round(score, 6))
    return found


def random_papers(seed, n=120, m=9, dim=6):
    rng = np.random.default_rng(seed)

    def paper():
        base = rng.normal(size=dim)
        sents = [(base + rng.normal(size=dim)).tolist() for _ in range(rng.integers(0, 6))]
        title = base if rng.random() > 0.05 else np.zeros(dim)
        return title.tolist(), sents

    entries = [("hot" if n_ % 3 == 0 else f"s{n_ % 4}", n_, *paper()) for n_ in range(n)]
    targets = [("hot" if n_ % 3 == 0 else f"s{n_ % 5}", n_, *paper()) for n_ in range(m)]
    return entries, targets


def rows(pairs):
    def score(value):
        return None if value is None or np.isnan(value) else round(value, 6)

    return {(r.target_pos, r.pos): (round(r.title_similarity, 6), score(r.top_k_score)) for r in pairs.collect()}


@pytest.mark.parametrize("use_and", [True, False])
@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed, use_and):
    entries, targets = random_papers(seed)
    settings = sim.Settings(3, 0.1, 0.4, use_and)
    e, t = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(targets, TARGET)
    expected = brute(entries, targets, settings)
    assert expected
    assert rows(sim.similar_pairs(e, t, settings)) == expected
    assert rows(sim.similar_pairs(e, t, settings, prune=False)) == expected
    assert rows(sim.similar_pairs(e, t, settings, spread=3)) == expected
    assert rows(sim.similar_pairs(e, t, settings, max_bytes=0)) == expected


@pytest.mark.parametrize("least", [None, -0.5, 0.0, 0.3, 0.7, 0.999])
@pytest.mark.parametrize("kind", ["clustered", "random", "few", "zeros"])
def test_screened_titles_are_those_of_the_whole_product(kind, least):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 32))
    draw = {
        "clustered": lambda n: centres[rng.integers(0, 8, n)] + 0.2 * rng.normal(size=(n, 32)),
        "random": lambda n: rng.normal(size=(n, 32)),
        "few": lambda n: rng.normal(size=(n if n > 100 else 3, 32)),
        "zeros": lambda n: rng.normal(size=(n, 32)) * (rng.random(n) > 0.3)[:, None],
    }[kind]
    block, titles = draw(400), draw(90)
    known = sim.SiteTargets(np.arange(len(titles)), titles, [titles[:0]] * len(titles))
    row, target, cosines, work = sim.screen_titles(known, block, least)
    full = sim._cosines(block, sim._norms(block), titles, sim._norms(titles))
    want = np.ones_like(full, bool) if least is None else full > least
    assert list(zip(row, target, strict=True)) == list(zip(*np.nonzero(want), strict=True))
    assert np.abs(cosines - full[want]).max(initial=0) < 2e-12
    assert work.sum() <= full.size
    if kind == "clustered" and least is not None and least > 0.5:
        assert 2 * work.sum() <= full.size and work.sum() < 1.5 * want.sum() + 400


def test_books_screen_titles_and_encode_once(spark, monkeypatch):
    """Above the bound, summaries of entries without a title hit are neither made ready nor encoded, and no text twice."""
    entries, targets = random_papers(7)
    e, t = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(targets, TARGET)
    settings = sim.Settings(3, 0.5, 0.4, True)
    prepared = []

    def prepare(rows):
        prepared.append(rows.count())
        return rows

    expected = brute(entries, targets, settings)
    assert rows(sim.similar_pairs(e, t, settings, max_bytes=200, prepare=prepare)) == expected
    assert len(prepared) == 1 and prepared[0] < len(entries) / 2
    assert prepared[0] >= len({pos for _, pos in expected})


def test_kernels_hold_bounded_pairs(monkeypatch):
    """However many targets a site has, a batch is scored in parts, and the parts give what the whole batch gives."""
    rng = np.random.default_rng(2)
    lengths = rng.integers(0, 5, 60)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    vectors = rng.integers(-1, 2, (offsets[-1], 3)).astype(float)  # many ties
    titles, targets = rng.normal(size=(60, 3)), rng.normal(size=(40, 3))
    sentences = [rng.integers(-1, 2, (n, 3)).astype(float) for n in rng.integers(0, 6, 40)]
    book = {"s": sim.SiteTargets(np.arange(40), targets, sentences)}
    sites = pa.array(["s" if n % 4 else "none" for n in range(60)])
    hits = sim._title_hits(book, sites, titles, 0.0)
    monkeypatch.setattr(sim, "PAIRS_HELD", 100)
    parts = list(sim._title_hits_in_parts(book, sites, titles, 0.0))
    assert len(parts) > 10 and pa.concat_arrays(parts).equals(hits)
    whole = {m: sim._best_sentences(book, sites, hits, offsets, vectors, m) for m in (None, 2)}
    for most, found in whole.items():
        sizes = sim._sentences_of_hits(book, sites, hits, most)
        cut = list(sim._parts(sizes, sim.PAIRS_HELD))
        assert [n for part in cut for n in range(part.start, part.stop)] == list(range(60))
        assert all(sizes[part].sum() <= 100 or part.stop == part.start + 1 for part in cut)
        monkeypatch.setattr(sim, "CELLS_HELD", 7)
        own = [
            sim._best_sentences(book, sim._in_part(sites, c), sim._in_part(hits, c), *sim._sentences_in_part(offsets, vectors, c), most)
            for c in cut
        ]
        assert pa.concat_arrays(own).equals(found)
    for row, scored in enumerate(whole[None].to_pylist()):
        expected = []
        for hit in hits[row].as_py():
            sims = [[cos(t, e) for e in vectors[offsets[row] : offsets[row + 1]]] for t in sentences[hit["target_pos"]]]
            expected += [(hit["target_pos"], i, int(np.argmax(np.round(x, 12)))) for i, x in enumerate(sims) if x]
        assert [(x["target_pos"], x["i"], x["j"]) for x in scored] == expected


@pytest.mark.parametrize("use_and", [True, False])
def test_targets_over_the_bound_meet_in_blocks(spark, monkeypatch, use_and):
    """However small the bound is, nothing is broadcast book by book; blocks of a few rows find every pair."""
    entries, targets = random_papers(9, m=30)
    e, t = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(targets, TARGET)
    settings = sim.Settings(3, 0.1, 0.4, use_and)
    monkeypatch.setattr(sim, "BLOCK_ENTRIES", 16)
    monkeypatch.setattr(sim, "BLOCK_TARGETS", 4)
    monkeypatch.setattr(spark.sparkContext, "broadcast", None)
    assert rows(sim.similar_pairs(e, t, settings, max_bytes=1)) == brute(entries, targets, settings)


def as_vectors(cosines):
    """Two-dimensional unit vectors whose cosine with (1, 0) is the given value."""
    return [[c, float(np.sqrt(1 - c * c))] for c in cosines]


@pytest.mark.parametrize(("k", "expected"), [(4, 0.85), (1, 0.9)])
def test_cap_and_ties(spark, k, expected):
    # target sentences are axis vectors, so entry sentence j has cosine m[i][j] with target sentence i
    target = np.eye(3).tolist()
    entry = np.array([[0.9, 0.2, 0.7], [0.1, 0.8, 0.7]])
    lengths = np.linalg.norm(entry, axis=1, keepdims=True)
    unit = np.hstack([entry / 2, np.sqrt(1 - (lengths / 2) ** 2)]).tolist()
    e = spark.createDataFrame([("s", 0, [1.0], unit)], ENTRY)
    t = spark.createDataFrame([("s", 0, [1.0], [[*v, 0.0] for v in target])], TARGET)
    book = sim.broadcast_targets(t)
    hits = sim.title_hits(e, book, 0.5)
    scored = sim.sentence_scores(hits, book, k).select(F.explode("scored").alias("s")).first()[0]
    assert round(scored.top_k_score * 2, 9) == expected
    best = {r.i: r.j for r in sim.best_sentences(hits, book).collect()}
    assert best == {0: 0, 1: 1, 2: 0}


def test_strict_threshold_and_missing_scores(spark):
    values = spark.createDataFrame([(0.82,), (0.8200001,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in values.select(sim.above("x", 0.82)).collect()] == [False, True, False, False]


def test_long_form_agrees(spark):
    entries, targets = random_papers(3)
    e, t = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(targets, TARGET)
    book = sim.broadcast_targets(t)
    hits = sim.title_hits(e, book, 0.0)
    direct = sim.sentence_scores(hits, book, 3).select("pos", F.explode("scored").alias("s"))
    direct = direct.where(~F.isnan("s.top_k_score") & F.col("s.top_k_score").isNotNull())
    expected = {(r.s.target_pos, r.pos): round(r.s.top_k_score, 9) for r in direct.collect()}
    best = sim.best_sentences(hits.withColumn("n_entry_sentences", F.size("sent_vecs")), book)
    sizes = t.select("target_pos", F.size("sent_vecs").alias("n_target_sentences"))
    ranked = sim.rank_sentence_matches(best.join(sizes, "target_pos"), ["target_pos", "pos"])
    scores = sim.top_k_score(sim.dynamic_top_k(ranked, 3), ["target_pos", "pos"])
    assert {(r.target_pos, r.pos): round(r.top_k_score, 9) for r in scores.collect()} == expected
    fixed = sim.top_k_score_fixed(ranked, ["target_pos", "pos"], 3)
    for r in fixed.collect():
        assert -1 <= r.top_k_score <= 1


def test_more_similar_sentences_never_raise_the_mean(spark):
    entries, targets = random_papers(4)
    e, t = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(targets, TARGET)
    means = []
    for k in (1, 2, 4):
        pairs = sim.similar_pairs(e, t, sim.Settings(k, -2.0, -2.0, True))
        means.append({(r.target_pos, r.pos): r.top_k_score for r in pairs.collect()})
    assert means[0].keys() == means[1].keys() == means[2].keys()
    for key in means[0]:
        assert means[0][key] >= means[1][key] - 1e-9 >= means[2][key] - 2e-9


def test_text_flow_equals_stored_vectors(spark):
    texts = [
        ("s", n, f"t{n % 7} graph theory (arXiv:1)", f"<p>One {n % 5} two. Three graph {n % 3}!</p>")
        for n in range(60)
    ]
    feed = spark.createDataFrame(texts, "site string, pos bigint, title string, summary string")
    papers = spark.createDataFrame(
        [("s", 0, n, f"p{n}", f"u{n}", f"t{n} graph theory", f"One {n} two. Three graph 1!") for n in range(3)],
        "site string, search_pos int, target_pos int, paper_id string, paper_url string, title string, summary string",
    )
    targets = plan.encode_targets(papers)
    settings = sim.Settings(2, 0.6, 0.5, True)
    direct = plan.similar_papers(feed, targets, settings)
    ready = plan.prepare_sentences(plan.prepare_titles(feed))
    stored = ready.select(
        "site", "pos",
        F.element_at(vc.encode_sentences(F.array("title")), 1).alias("title_vec"),
        vc.encode_sentences(F.col("sentences")).alias("sent_vecs"),
    )
    expected = rows(sim.similar_pairs(stored, targets, settings))
    assert expected
    assert rows(direct) == expected
    assert rows(plan.similar_papers(feed, targets, settings, prune=False)) == expected
    assert rows(plan.similar_papers(feed, targets, settings, max_target_bytes=0)) == expected


def test_encoder_forms_agree(spark):
    texts = ["A b c, b!", "", "Été 2024 x_y"]
    data = spark.createDataFrame([(texts,)], "s array<string>")
    by_python = data.select(vc.encode_sentences(F.col("s"))).first()[0]
    by_sql = data.select(F.transform("s", lambda t: vc.hashed_vector(t))).first()[0]
    assert by_python == by_sql
    assert sum(by_python[0]) == 4


def test_custom_encoder_and_batches(spark):
    def factory():
        return lambda sentences: np.array([[len(s), 1.0] for s in sentences])

    data = spark.createDataFrame([(0, ["a", "bb", "ccc"]), (1, []), (2, None), (3, ["dddd"])], "n int, s array<string>")
    found = data.select("n", vc.encode_sentences(F.col("s"), factory, batch_size=2).alias("v")).orderBy("n").collect()
    assert [r.v for r in found] == [[[1, 1], [2, 1], [3, 1]], [], [], [[4, 1]]]


@pytest.mark.parametrize(("mask", "expected"), [([1, 1, 0], [2.0, 3.0]), ([0, 0, 0], [0.0, 0.0])])
def test_mean_pooling(spark, mask, expected):
    tokens = [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]
    row = spark.createDataFrame([(tokens, mask)], "t array<array<double>>, m array<int>")
    assert row.select(vc.masked_mean_pool(F.col("t"), F.col("m"))).first()[0] == expected
    long = spark.createDataFrame([("o", t, m) for t, m in zip(tokens, mask)], "o string, t array<double>, m int")
    assert vc.masked_mean_pool_rows(long, "o", "t", "m").first().vec == expected


def test_cosine_edges(spark):
    row = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0], [2.0, 4.0])], "z array<double>, a array<double>, b array<double>")
    found = row.select(vc.cosine_similarity("z", "a"), F.round(vc.cosine_similarity("a", "b"), 12)).first()
    assert tuple(found) == (0.0, 1.0)


def test_no_exchange_and_python_runs_once(spark):
    entries, targets = random_papers(0)
    e, t = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(targets, TARGET)
    pairs = sim.similar_pairs(e, t, sim.Settings(3, 0.1, 0.4, True))
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text and "Cartesian" not in text
    assert text.count("ArrowEvalPython") == 2


def test_queries_over_books_of_targets(spark):
    """Above the bound, books of targets give the rows that one book gives."""
    from feedwatch.registry import similarity as reg

    sf = "/root/testdata/sf0.001"
    keys = ["site", "pos", "target_pos"]

    def hits(most):
        return reg.screened(spark, sf, max_bytes=most).select("site", "pos", F.explode("hits").alias("h")).select("site", "pos", "h.*")

    def scores(most):
        return reg.scored_pairs(spark, sf, most).select("site", "pos", F.explode("scored").alias("s")).select("site", "pos", "s.*")

    def sentences(most):
        return reg.best(spark, sf, most).select(*keys, "i", "j", "similarity", "n_entry_sentences")

    assert sim.broadcast_targets(reg.v.vector_targets(spark, sf), 4_000) is None
    for rows in (hits, scores, sentences):
        one = sorted(map(tuple, rows(64 << 20).collect()))
        assert one and sorted(map(tuple, rows(4_000).collect())) == one


def test_report_over_books_of_targets(spark):
    from feedwatch.registry import composites as comp
    from feedwatch.registry import views as v

    sf = "/root/testdata/sf0.001"
    entries, targets = v.delivered(spark, sf), comp.targets_of(spark, sf)
    assert sim.target_bytes(targets) > 4_000

    def rows(most):
        return sorted(map(tuple, plan.sentence_report(entries, targets, comp.SET, 4, max_target_bytes=most).collect()))

    one = rows(64 << 20)
    assert one and rows(sim.target_bytes(targets) // 2) == one
