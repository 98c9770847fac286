from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from feedwatch import schemas
from feedwatch.functions import formats as fmt
from feedwatch.operators import digest as dg
from feedwatch.operators.digest import digest_concat
from feedwatch.plans.daily import daily_digest
from tests.test_match import make_entries, make_watch

RUN = dt.date(2026, 12, 1)


def passthrough(placed, keep):
    return placed.select(*keep, "html", F.upper("html").alias("plain"))


def skewed(seed, n=2000):
    """Half of all entries belong to one site; positions have gaps."""
    rng = random.Random(seed)
    positions = rng.sample(range(10 * n), n)
    return [("hot" if rng.random() < 0.5 else f"s{rng.randrange(9)}", p, f"<{p}>") for p in positions]


@pytest.mark.parametrize("per_part", [1, 7, 100, 100_000])
def test_parts_make_the_message(spark, per_part):
    rows = skewed(per_part)
    items = spark.createDataFrame(rows, "site string, pos bigint, html string")
    parts = digest_concat(
        items, ["site"], ["pos"], passthrough, F.concat(F.lit("["), "site"), F.lit("]"), F.lit("#"), per_part
    )
    expected = {}
    for site, _, html in sorted(rows, key=lambda r: r[1]):
        expected.setdefault(site, []).append(html)
    found = {}
    for r in sorted(parts.collect(), key=lambda r: r.part):
        found.setdefault(r.site, []).append(r)
    assert found.keys() == expected.keys()
    for site, texts in expected.items():
        group = found[site]
        body = "".join(texts)
        assert "".join(r.html for r in group) == f"[{site}{body}]"
        assert "".join(r.plain for r in group) == f"#{body.upper()}"
        assert [r.part for r in group] == list(range(len(group)))
        assert {(r.n_parts, r.n_entries) for r in group} == {(len(group), len(texts))}
        for r in group:
            assert r.html.count("<") < 2 * per_part


def test_entry_without_position_fails(spark):
    items = spark.createDataFrame([("s", 0, "a"), ("s", None, "b")], "site string, pos bigint, html string")
    with pytest.raises(Exception, match="no position"):
        digest_concat(items, ["site"], ["pos"], passthrough, F.lit(""), F.lit("")).collect()


def test_order_with_leading_columns(spark):
    rows = [("s", day, pos, f"{day}.{pos} ") for day in range(5) for pos in range(20)]
    random.Random(0).shuffle(rows)
    items = spark.createDataFrame(rows, "site string, day int, pos bigint, html string")
    parts = digest_concat(items, ["site"], ["day", "pos"], passthrough, F.lit(""), F.lit(""), per_part=8)
    text = "".join(r.html for r in sorted(parts.collect(), key=lambda r: r.part))
    assert text == "".join(f"{d}.{p} " for d in range(5) for p in range(20))


def test_gaps_between_positions(spark):
    """Positions 1,000 apart: the plan has a few rows a part, and only rows a range are summed over a site."""
    items = spark.range(6000).selectExpr("if(id % 3 = 0, 'hot', 'cold') AS site", "id * 1000 AS pos", "concat('<', id, '>') AS html")
    ranged = dg.in_ranges(items, ["site"], ["pos"], 100)
    layout = dg.digest_layout(ranged, ["site"], ["pos"], 100)
    ranges = ranged.selectExpr("shiftrightunsigned(_row, 33) AS r").distinct().count()
    assert layout.count() <= 60 + 2 * ranges
    assert {(r.site, r.n) for r in layout.selectExpr("if(n_entries = 2000, 'hot', 'cold') AS site", "n_parts AS n").collect()} == {
        ("hot", 20), ("cold", 40)
    }
    # what a window over a whole site reads has been summed up: a row a range, or a row a part in a range
    plan = dg.digest_layout(ranged, ["site"], ["pos"], 100)._jdf.queryExecution().optimizedPlan().toString()
    lines = [re.sub(r"^[\s:+|-]*", "", line) for line in plan.splitlines()]
    over_sites = [i for i, line in enumerate(lines) if re.search(r"^Window .*\], \[site#\d+\]", line)]
    assert over_sites
    for i in over_sites:
        below = next(line for line in lines[i:] if not line.startswith(("Window", "Project")))
        assert re.match(r"Aggregate \[site#\d+, _range#", below)


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_parts_bounded_by_bytes(spark, ranges, monkeypatch):
    """Whatever the ranges, parts are cut where the running sums say, and a large entry stands alone."""
    rng = random.Random(ranges)
    rows = [("hot" if rng.random() < 0.8 else None, p, "x" * rng.choice([1, 5, 40, 300])) for p in rng.sample(range(900), 400)]
    items = spark.createDataFrame(rows, "site string, pos bigint, html string")
    per_range = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small ranges stay apart
    try:
        parts = digest_concat(items, ["site"], ["pos"], passthrough, F.lit(""), F.lit(""), per_part=20, part_bytes=500).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", per_range)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for site in ("hot", None):
        own = sorted((p, x) for s, p, x in rows if s == site)
        at, size, want = {}, 0, {}
        for i, (p, x) in enumerate(own):
            key = (at.setdefault(p // 20, i) // 20, size // 500)
            want.setdefault(key, []).append(x)
            size += len(x) + len(site or "")
        found = sorted((r.part, r.html, r.n_parts, r.n_entries) for r in parts if r.site == site)
        assert found == [(k, "".join(want[key]), len(want), len(own)) for k, key in enumerate(sorted(want))]


def test_daily_digest(spark):
    entries = make_entries(
        spark,
        [("cs", "On compilers", "A, B", "x"), ("cs", "A compiler", "A, B", "y Abstract: z"),
         ("gr", "Nothing", "A, B", "z"), ("cs", "More", "Q, B Cee", None)],
    )
    watch = make_watch(spark, [("cs", ["Cee"], ["compiler"]), ("gr", ["X"], None), ("cs", None, ["on"])])
    found = {(r.config_pos, r.kind): r for r in daily_digest(entries, watch, RUN).collect()}
    assert {k: r.n_entries for k, r in found.items()} == {(0, "daily"): 3}
    digest = found[0, "daily"]
    assert digest.subject == "Filtered Arxiv cs"
    assert digest.html.startswith(fmt.MATCH_HEADER + "<div>") and digest.html.endswith(fmt.MATCH_FOOTER)
    assert digest.plain == "On compilers\n \tA, B\n \n\n \nA compiler\n \tA, B\n \n z\n \nMore\n \tQ, B Cee\n \n\n \n"
    assert daily_digest(entries, watch, RUN).schema.fieldNames() == schemas.DIGEST.fieldNames()


def test_nothing_found(spark):
    entries = make_entries(spark, [("cs", "Title", "A", "x")])
    row = daily_digest(entries, make_watch(spark, [("cs", ["Q"], ["q"])]), RUN).collect()
    assert [(r.kind, r.subject, r.html) for r in row] == [
        ("notice", fmt.NOTHING_FOUND, f"<b>{fmt.NOTHING_FOUND}</b>")
    ]
    empty = daily_digest(entries, make_watch(spark, []), RUN).collect()
    assert [r.kind for r in empty] == ["notice"]
