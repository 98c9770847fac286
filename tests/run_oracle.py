"""Print differences and times: ``python -m tests.run_oracle [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

from __spark_entry__ import oracle_sql, queries
from feedwatch.session import build_session
from tests.oracle import compare, connect


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> None:
    spark = build_session(
        "oracle",
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    found, sql = queries(), oracle_sql()
    bad = 0
    for name in names or sorted(found):
        start = time.time()
        try:
            problem = compare(found[name](spark, sf_dir), con, sql[name])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} of {len(names or found)} differ")


if __name__ == "__main__":
    main(*sys.argv[1:])
