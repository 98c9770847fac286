from __future__ import annotations

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from feedwatch import schemas
from feedwatch.operators import joins
from feedwatch.operators import many_terms as mt_many
from feedwatch.operators import match as mt
from feedwatch.session import durable


def make_entries(spark, rows):
    """(site, title, author, summary) rows as entries."""
    full = [
        (site, n, str(n), title, author, summary, f"l{n}", None)
        for n, (site, title, author, summary) in enumerate(rows)
    ]
    return spark.createDataFrame(full, schemas.ENTRY)


def make_watch(spark, rules):
    return spark.createDataFrame([(n, *rule) for n, rule in enumerate(rules)], schemas.WATCH)


CASES = [
    ("X Y, Ann Lee", "On compilers", "...", ["Ann Lee"], ["compiler"], "author"),
    ("Ann Lee, X Y", "On graphs", "none here", ["Ann Lee"], [], ""),
    ("X Y, ann lee", "On graphs", "none here", ["Ann Lee"], [], ""),
    ("X Y", "Compiler design", "a COMPILER", [], ["compiler"], "summary"),
    ("X Y", "Compiler for a compiler", "none here", [], ["compiler"], ""),
    ("X Y", "An RTOS", "...", [], ["rtos"], "title"),
    ("X Y", "An RTOS", "...", None, None, ""),
    ("X Y", "An RTOS", "...", [], [""], ""),
    (None, None, "an rtos", ["A", None], [None, "RTOS"], "summary"),
    (None, None, None, ["A"], ["b"], ""),
]


def test_classification(spark):
    entries = make_entries(spark, [(f"s{n}", c[1], c[0], c[2]) for n, c in enumerate(CASES)])
    watch = make_watch(spark, [(f"s{n}", c[3], c[4]) for n, c in enumerate(CASES)])
    found = {r.pos: r.match for r in mt.classify_entries(entries, watch).collect()}
    assert found == {n: c[5] for n, c in enumerate(CASES)}
    anywhere = {r.pos: r.match for r in mt.classify_entries(entries, watch, True).collect()}
    assert anywhere[1] == "author"
    assert anywhere[3] == "title"


def brute_label(author, title, summary, authors, words):
    if any(author.find(a) > 0 for a in authors):
        return "author"
    for name, text in (("title", title), ("summary", summary)):
        if any(text.lower().find(w.lower()) > 0 for w in words):
            return name
    return ""


def random_feed(seed, n=300):
    rng = random.Random(seed)
    parts = ["ab", "Ba", "c", "ét", " "]

    def text(k):
        return "".join(rng.choices(parts, k=k))

    rows = [("hot" if rng.random() < 0.4 else rng.choice("pqr"), text(4), text(5), text(9)) for _ in range(n)]
    rules = [(s, [text(1), text(2)], [text(2), text(3)]) for s in ("hot", "p", "q", "hot")]
    return rows, rules


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows, rules = random_feed(seed)
    entries, watch = make_entries(spark, rows), make_watch(spark, rules)
    expected = {}
    for (pos, (site, title, author, summary)), (rule, (watched, authors, words)) in itertools.product(
        enumerate(rows), enumerate(rules)
    ):
        if site == watched:
            expected[rule, pos] = brute_label(author, title, summary, authors, words)
    found = {(r.rule_pos, r.pos): r.match for r in mt.classify_entries(entries, watch).collect()}
    assert found == expected
    by_index = mt_many.classify_many_terms(entries, watch).collect()
    assert {(r.rule_pos, r.pos): r.match for r in by_index} == expected
    by_shuffle = mt_many.classify_many_terms(entries, watch, max_bytes=0).collect()
    assert {(r.rule_pos, r.pos): r.match for r in by_shuffle} == expected
    matched = {k: v for k, v in expected.items() if v}
    assert {(r.rule_pos, r.pos): r.match for r in mt.matched_entries(entries, watch).collect()} == matched
    hits = mt.any_term(mt.term_hits(entries, watch), ["rule_pos", "pos"])
    assert {(r.rule_pos, r.pos): r.match for r in hits.collect()} == matched


def test_fifty_thousand_terms(spark):
    """Equal labels, with terms of all lengths and letters outside ASCII, and faster than a search for each term."""
    rng = random.Random(8)
    letters = "abcdeé日"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    rows = [("cs", word(9), f"{word(6)} {word(5)}", " ".join(word(rng.randint(3, 9)) for _ in range(30))) for _ in range(30)]
    terms = [word(n) for n in (1, 2, 3, 8) for _ in range(2)] + [f"{word(3)}zq{n:05d}" for n in range(50_000)] + [rows[3][3][40:52].upper()]
    entries, watch = make_entries(spark, rows), make_watch(spark, [("cs", ["eé", "", rows[5][2][1:]], terms), ("cs", None, ["日"])])
    entries, watch = durable(entries, "entries"), durable(watch, "watch")
    times, labels = [], []
    for label in (mt.classify_entries, mt_many.classify_many_terms):
        began = time.perf_counter()
        labels.append({(r.rule_pos, r.pos): r.match for r in label(entries, watch).select("rule_pos", "pos", "match").collect()})
        times.append(time.perf_counter() - began)
    assert labels[0] == labels[1] and len(set(labels[0].values())) == 4
    for zero in (True, False):
        few = make_watch(spark, [("cs", ["a"], ["b", "日é"])])
        want = {(r.rule_pos, r.pos): r.match for r in mt.classify_entries(entries, few, zero).collect()}
        assert {(r.rule_pos, r.pos): r.match for r in mt_many.classify_many_terms(entries, few, zero).collect()} == want
    assert mt_many.classify_many_terms(entries, make_watch(spark, [("cs", None, None)])).where("match = ''").count() == 30


def test_large_watchlist_is_salted_with_equal_result(spark, monkeypatch):
    rows, rules = random_feed(7)
    entries, watch = make_entries(spark, rows), make_watch(spark, rules)
    small = mt.matched_entries(entries, watch)
    monkeypatch.setattr(mt, "join_small", lambda *a, **k: joins.join_small(*a, **k, max_bytes=0))
    salted = mt.matched_entries(entries, watch)
    assert sorted(map(str, small.collect())) == sorted(map(str, salted.select(*small.columns).collect()))
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_more_terms_never_lose_matches(spark):
    rows, rules = random_feed(5)
    entries = make_entries(spark, rows)
    wider = [(s, a, [*w, "zz", "c"]) for s, a, w in rules]
    before = {(r.rule_pos, r.pos) for r in mt.matched_entries(entries, make_watch(spark, rules)).collect()}
    after = {(r.rule_pos, r.pos) for r in mt.matched_entries(entries, make_watch(spark, wider)).collect()}
    assert before <= after


def test_empty_configuration(spark):
    entries = make_entries(spark, [("s", "t", "a", "x")])
    watch = make_watch(spark, [])
    row = mt.all_sites_empty(watch, mt.matched_entries(entries, watch)).first()
    assert (row.n_rules, row.n_empty, row.all_empty) == (0, 0, True)


def test_plan_keeps_entries_in_place(spark):
    """The feed is scanned with pruned columns and joined by broadcast, without an exchange."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    entries = docs.select(
        F.col("source").alias("site"), F.col("doc_id").alias("pos"), F.col("text").alias("title"),
        F.col("lang").alias("author"), F.col("text").alias("summary"),
    )
    watch = make_watch(spark, [("src1", ["a"], ["b"])])
    plan = mt.matched_entries(entries, watch).select("pos", "match")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan
    assert "n_chars" not in plan
