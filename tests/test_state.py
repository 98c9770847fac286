from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from feedwatch import schemas
from feedwatch.functions import formats as fmt
from feedwatch.plans import weekly as wk
from feedwatch.plans.journal import run_journal
from feedwatch.session import fresh_path
from feedwatch.sources.state import MatchState, SeenLinks, read_digests
from feedwatch.streaming import flows, snapshots
from tests.test_match import make_entries, make_watch

MON, SUN, NEXT = dt.date(2026, 11, 30), dt.date(2026, 12, 6), dt.date(2026, 12, 13)


def snapshot(spark, links, site="journal"):
    rows = [(site, n, link, None, None, None, link, None) for n, link in enumerate(links)]
    return spark.createDataFrame(rows, schemas.ENTRY)


STEPS = [
    (["a", "b"], ["a", "b"], {"a", "b"}),
    (["b"], None, {"a", "b"}),
    (["b", "c", "c"], ["c", "c"], {"b", "c"}),
    (["a", "b"], ["a"], {"a", "b"}),
    ([None, "b"], [None], {None, "b"}),
    ([None, "b"], None, {None, "b"}),
]


def test_snapshots(spark):
    base = fresh_path(spark, "journal")
    state = SeenLinks(spark, base)
    assert state.read().count() == 0
    for n, (links, new, stored) in enumerate(STEPS):
        path = f"{base}/digests{n}"
        assert run_journal(snapshot(spark, links), state, path, MON) is (new is not None)
        assert {r.link for r in state.read().collect()} == stored
        found = read_digests(spark, path).collect()
        assert [r.n_entries for r in found] == ([] if new is None else [len(new)])
        if new is not None:
            assert found[0].plain.startswith(fmt.JOURNAL_PLAIN_HEADER)
            assert found[0].plain.count("No Title") == len(new)


def test_uncommitted_version_is_not_seen(spark):
    state = SeenLinks(spark, fresh_path(spark, "seen"))
    state.write(spark.createDataFrame([("a",)], schemas.SEEN_LINK), 1)
    # a job that died after writing the links but before committing them
    spark.createDataFrame([("x",)], schemas.SEEN_LINK).write.parquet(f"{state.base}/links/v2")
    assert [r.link for r in state.read().collect()] == ["a"]
    state.write(spark.createDataFrame([("b",)], schemas.SEEN_LINK), 2)
    assert [r.link for r in state.read().collect()] == ["b"]


def test_snapshot_stream_and_retry(spark):
    base = fresh_path(spark, "stream")
    for n, (links, _, _) in enumerate(STEPS[:4]):
        flows.land_snapshot(snapshot(spark, links).repartition(2), base, f"s{n}")
    state = SeenLinks(spark, base)

    def run(checkpoint):
        flows.start_new_entries_stream(spark, base, state, f"{base}/digests", MON, checkpoint).awaitTermination()
        found = read_digests(spark, f"{base}/digests").collect()
        return {int(r.run_id[1:]) - 1: r.n_entries for r in found}

    # snapshots without news take a version too, so digests are numbered by snapshot
    expected = {n: len(new) for n, (_, new, _) in enumerate(STEPS[:4]) if new}
    assert run(f"{base}/checkpoint") == expected
    assert {r.link for r in state.read().collect()} == {"a", "b"}
    # all batches again, as after a lost checkpoint: each version is committed, so nothing changes
    assert run(f"{base}/checkpoint2") == expected


def test_many_feeds_in_one_stream(spark):
    """Each feed's steps as in the batch form, from a stream that is stopped and started again between them."""
    base = fresh_path(spark, "feeds")
    kinds = f"{schemas.ENTRY.simpleString()[7:-1].replace(':', ' ')}, snapshot bigint"
    feeds = {"f": 0, "g": 2, "h": 3}  # the feeds begin with different steps
    for number, batch in enumerate(((0, 1, 2), (3,), (4, 5))):
        rows = [
            (site, p, f"{n}.{p}", "t" * 9, None, None, link, None, n)
            for n in batch for site, first in feeds.items() if n >= first for p, link in enumerate(STEPS[n][0])
        ]
        spark.createDataFrame(rows, kinds).repartition(3).write.mode("append").parquet(f"{base}/landed")
        landed = spark.readStream.schema(kinds).parquet(f"{base}/landed")
        snapshots.start_new_keys_stream(landed, f"{base}/new", f"{base}/checkpoint").awaitTermination()
    keys = spark.read.schema(snapshots.KEYS).parquet(f"{base}/new")
    found = {}
    for r in snapshots.entries_of(keys, spark.read.schema(kinds).parquet(f"{base}/landed")).orderBy("snapshot", "pos").collect():
        found.setdefault(r.site, []).append((r.snapshot, r.link))
    for site, first in feeds.items():
        state = SeenLinks(spark, fresh_path(spark, "one"))
        want = []
        for n, (links, _, _) in enumerate(STEPS[first:], first):
            held = {r.link for r in state.read().collect()}
            new = [x for x in links if x not in held]
            want += [(n, x) for x in new]
            if new:
                state.write(spark.createDataFrame([(x,) for x in set(links)], schemas.SEEN_LINK), n + 1)
        assert found[site] == want
    assert found["f"] == [(n, x) for n, (_, new, _) in enumerate(STEPS) for x in new or []]


@pytest.fixture
def weekly(spark):
    base = fresh_path(spark, "weekly")
    watch = make_watch(spark, [("cs", ["Ann Lee"], ["rtos"]), ("gr", [], ["x-x"])])
    state = MatchState(spark, base)
    monday = make_entries(spark, [("cs", "T1", "B, Ann Lee", "s"), ("cs", "T2", "B", "s")])
    sunday = make_entries(spark, [("cs", "An RTOS", "B", "s"), ("gr", "T3", "B", "s")])

    def run(entries, day, run_id=None, sites=("cs", "gr")):
        rules = watch.where(F.col("site").isin(*sites))
        return wk.run_weekly(entries, rules, state, f"{base}/digests", day, run_id=run_id)

    def sent(day):
        rows = read_digests(spark, f"{base}/digests").where(F.col("run_date") == F.lit(day)).collect()
        return {(r.site, r.kind) if r.run_id == str(day) else (r.run_id, r.site, r.kind): (r.n_entries, r.subject) for r in rows}

    return run, sent, state, monday, sunday


FIRST = {
    ("cs", "author"): (1, "Filtered author matches for cs"),
    ("cs", "keyword"): (1, "Filtered matches for cs"),
    ("gr", "author"): (0, "No author matches found for gr arxiv topic"),
    ("gr", "keyword"): (0, "No keyword matches found for gr arxiv topic"),
}


def test_weekly_flush(weekly):
    run, sent, state, monday, sunday = weekly
    assert run(monday, MON) is False
    assert sent(MON) == {}
    assert run(sunday, SUN) is True
    assert sent(SUN) == FIRST
    # the same run again sends nothing and loses nothing of the first
    assert run(sunday, SUN) is False
    assert sent(SUN) == FIRST
    # another run of that Sunday sends what it brought, beside the first
    assert run(sunday, SUN, "evening") is True
    again = sent(SUN)
    assert {k: v for k, v in again.items() if k in FIRST} == FIRST
    assert again["evening", "cs", "keyword"][0] == 1 and again["evening", "cs", "author"][0] == 0
    assert run(sunday, NEXT) is True
    assert {k: n for k, (n, _) in sent(NEXT).items()} == {
        ("cs", "author"): 0, ("cs", "keyword"): 1, ("gr", "author"): 0, ("gr", "keyword"): 0
    }


def test_late_rows_absent_sites_and_repeats(weekly, spark):
    run, sent, state, monday, sunday = weekly
    watch = make_watch(spark, [("cs", ["Ann Lee"], ["rtos"]), ("gr", ["B"], ["x-x"])])
    assert run(monday, SUN, sites=("gr",)) is True  # nothing of gr
    assert sent(SUN) == {k: v for k, v in FIRST.items() if k[0] == "gr"}
    # saved under an old date after the flush, and for a site that the next watchlist lacks
    late = wk.weekly_matches(make_entries(spark, [("cs", "An RTOS", "x", "s"), ("gr", "T", "x, B", "s")]), watch, MON)
    assert state.append(late, "late") is True
    assert state.append(late, "late") is False
    assert state.read().count() == 2
    run(sunday.where("false"), NEXT, sites=("cs",))
    assert {k: n for k, (n, _) in sent(NEXT).items()} == {("cs", "author"): 0, ("cs", "keyword"): 1}
    assert [r.site for r in state.pending(NEXT).collect()] == ["gr"]


def test_dead_attempt_is_not_seen(spark):
    state = MatchState(spark, fresh_path(spark, "dead"))
    rows = wk.weekly_matches(make_entries(spark, [("cs", "An RTOS", "B", "s")]), make_watch(spark, [("cs", [], ["rtos"])]), MON)
    dead = rows.withColumns({"run_id": F.lit("r"), "attempt": F.lit("a")})
    dead.write.partitionBy("week", "site").parquet(state.matches_path)
    assert state.read().count() == 0
    assert state.append(rows, "r") is True
    assert state.read().count() == 1 and state.pending(SUN).count() == 1


def test_missed_sunday(weekly):
    run, sent, state, monday, sunday = weekly
    run(monday, MON)
    assert run(sunday, NEXT) is True
    assert sent(NEXT) == FIRST


def test_flush_partitions_state(spark):
    days = [dt.date(2026, 11, 1) + dt.timedelta(days=n) for n in range(40)]
    rows = spark.createDataFrame([(d,) for d in days], "append_date date")
    runs = spark.createDataFrame([(d,) for d in days if d != SUN], "run_date date")
    found = {r.append_date: r.flush_date for r in wk.flush_dates(rows, runs).collect()}
    sundays = [d for d in days if d.weekday() == 6 and d != SUN]
    assert found == {d: min((s for s in sundays if s >= d), default=None) for d in days}


def test_site_listed_twice(spark):
    watch = make_watch(spark, [("cs", ["Ann"], ["a"]), ("cs", None, ["b"])])
    rules = wk.rules_by_site(watch).collect()
    assert [(r.config_pos, r.authors, r.words) for r in rules] == [(0, ["Ann"], ["a", "b"])]


def test_match_stream_equals_batch(spark):
    base = fresh_path(spark, "matches")
    watch = make_watch(spark, [("cs", ["Lee"], ["rtos"])])
    entries = make_entries(spark, [("cs", "An RTOS", "B", "s"), ("cs", "T", "B Lee", "s"), ("cs", "T", "B", "s")])
    entries.repartition(3).write.parquet(f"{base}/landed")
    stream = spark.readStream.schema(schemas.ENTRY).parquet(f"{base}/landed")
    state = MatchState(spark, base)
    flows.start_match_stream(stream, watch, F.lit(MON), state, f"{base}/cp").awaitTermination()
    batch = wk.weekly_matches(entries, watch, MON)
    streamed = state.read()
    assert sorted(map(str, batch.select(*streamed.columns).collect())) == sorted(map(str, streamed.collect()))
    # a lost checkpoint appends nothing twice, and batch runs add to the same state
    flows.start_match_stream(stream, watch, F.lit(MON), state, f"{base}/cp2").awaitTermination()
    assert state.read().count() == batch.count()
    state.append(wk.weekly_matches(entries, watch, SUN), "batch")
    assert state.read().count() == 2 * batch.count() == state.pending(SUN).count()


def test_pruned_state_reads(spark):
    state = MatchState(spark, fresh_path(spark, "pruned"))
    rows = make_entries(spark, [("cs", "An RTOS", "B", "s")])
    state.append(wk.weekly_matches(rows, make_watch(spark, [("cs", [], ["rtos"])]), MON))
    plan = state.read("cs", MON)._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "site" in filters and "week" in filters


def test_append_opens_its_own_files_only(spark):
    """After the files of all earlier runs are spoilt, a run is appended and its week read as if nothing were there."""
    base = fresh_path(spark, "history")
    state = MatchState(spark, base)
    watch = make_watch(spark, [("cs", [], ["rtos"]), ("a b/c+d%[x]", [], ["rtos"])])
    rows = make_entries(spark, [("cs", "An RTOS", "B", "s"), ("a b/c+d%[x]", "The RTOS", "B", "s")])
    days = [MON + dt.timedelta(days=7 * n) for n in range(5)]
    for n, day in enumerate(days):
        assert state.append(wk.weekly_matches(rows, watch, day), f"run/{n}") is True
    assert state.read().count() == 10 and state.read("a b/c+d%[x]").count() == 5
    one = state.read(week=days[1])
    assert one.count() == 2 and len(one.inputFiles()) == 2  # a file for each of the sites
    for path in [*Path(f"{base}/matches").rglob("*.parquet"), *Path(f"{base}/matches").rglob(".*.crc")]:
        path.write_bytes(b"spoilt")
    day = days[-1] + dt.timedelta(days=7)
    assert state.append(wk.weekly_matches(rows, watch, day), "after") is True
    assert state.append(wk.weekly_matches(rows, watch, day), "after") is False
    assert {r.site for r in state.read(week=day).collect()} == {"cs", "a b/c+d%[x]"}
    log = state.committed_slices()
    assert log.where(F.col("run_id") == "after").count() == 2 and log.count() == 12
    assert state.append(wk.weekly_matches(rows.where("false"), watch, day), "nothing") is True
    assert state.append(wk.weekly_matches(rows.where("false"), watch, day), "nothing") is False


def test_first_copies(spark):
    watch = make_watch(spark, [("cs", [], ["rtos"])])
    rows = make_entries(spark, [("cs", "An RTOS", "B", "s"), ("cs", "The RTOS", "B", "s")])
    saved = wk.weekly_matches(rows, watch, SUN).unionAll(wk.weekly_matches(rows, watch, MON))
    assert saved.count() == 4
    kept = wk.first_copies(saved)
    assert kept.columns == saved.columns
    assert {(r.entry.id, r.append_date) for r in kept.collect()} == {("0", MON), ("1", MON)}


def test_first_copies_without_id(spark):
    watch = make_watch(spark, [("cs", [], ["rtos"])])
    rows = make_entries(spark, [("cs", "An RTOS", "B", "s"), ("cs", "The RTOS", "B", "s")])
    bare = rows.withColumn("id", F.lit(None).cast("string"))
    for kept, n in ((bare.withColumn("link", F.col("title")), 2), (bare.withColumn("link", F.lit("same")), 1), (bare.withColumn("link", F.lit(None).cast("string")), 2)):
        assert wk.first_copies(wk.weekly_matches(kept, watch, SUN)).count() == n


def test_first_seen_is_cumulative(spark):
    base = fresh_path(spark, "first-seen")
    for day, links in enumerate((["a", "b"], ["b", "c"], ["a"])):
        stamped = snapshot(spark, links).withColumn("snapshot_ts", F.lit(dt.datetime(2026, 12, 1 + day)))
        stamped.coalesce(1).write.mode("append").parquet(f"{base}/landed")
    kinds = spark.read.parquet(f"{base}/landed").schema
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{base}/landed")
    query = (
        flows.first_seen(stream).writeStream.format("parquet").option("checkpointLocation", f"{base}/cp")
        .trigger(availableNow=True).start(f"{base}/out")
    )
    query.awaitTermination()
    assert sorted(r.link for r in spark.read.parquet(f"{base}/out").collect()) == ["a", "b", "c"]
