"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from feedwatch.functions import html as hm
from feedwatch.operators import match as mt
from feedwatch.operators import novelty as nv
from feedwatch.operators.similarity import Settings
from feedwatch.plans import similar as sp
from feedwatch.plans import weekly as wk
from feedwatch.plans.daily import daily_digest
from feedwatch.plans.journal import new_entries_digest
from feedwatch.plans.metadata import metadata_table
from feedwatch.registry import views as v
from feedwatch.registry.similarity import attached
from feedwatch.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def consume(df) -> None:
    """Run the whole plan and every column of it; nothing comes back to the driver."""
    df.write.format("noop").mode("overwrite").save()


def cases(spark) -> dict:
    entries = v.entries(spark, SF_DIR)
    watch = v.watch(spark)
    snapshot, stored = v.snapshot(spark, SF_DIR), v.stored(spark, SF_DIR)
    pages = v.table(spark, SF_DIR, "pages")
    saved = v.saved(spark, SF_DIR)

    def similar(settings: Settings, prune: bool = True):
        targets = sp.encode_targets(attached(spark, SF_DIR))
        return sp.similar_papers(
            v.delivered(spark, SF_DIR), targets, settings, prune=prune, spread=int(CPUS)
        )

    return {
        "match_array": lambda: mt.matched_entries(entries, watch).select("rule_pos", "pos", "match"),
        "match_exploded": lambda: mt.any_term(
            mt.term_hits(entries, watch), ["rule_pos", "site", "pos"]
        ),
        "daily_digest": lambda: daily_digest(v.marked(spark, SF_DIR), watch, v.RUN_DATE),
        "weekly_flush": lambda: wk.weekly_digest(saved, v.saved_watch(spark), v.RUN_DATE),
        "similar_pruned": lambda: similar(v.TEXT_SETTINGS),
        "similar_unpruned": lambda: similar(v.TEXT_SETTINGS, prune=False),
        "new_since_snapshot": lambda: nv.new_entries(snapshot, stored),
        "journal_digest": lambda: new_entries_digest(snapshot, stored, v.RUN_DATE),
        "html_to_text_sql": lambda: pages.select(hm.html_to_text_sql("html").alias("t")),
        "html_to_text_parser": lambda: pages.select(hm.html_to_text("html").alias("t")),
        "oai_metadata": lambda: metadata_table(v.record_pages(spark, SF_DIR), "set_name").groupBy(
            "site"
        ).agg(F.count("*").alias("n")),
    }


def main(*names: str) -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, build in cases(spark).items():
        if names and name not in names:
            continue
        runs = []
        for _ in range(REPEATS + 1):  # the first run warms up code generation and workers
            start = time.perf_counter()
            consume(build())
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main(*sys.argv[1:])
