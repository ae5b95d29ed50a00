"""Run registered queries against SQL: python -m tests.check_queries [sf] [key prefix ...]"""

import sys
import time

from __spark_entry__ import oracle_sql, queries
from commercelake.session import build_session
from tests.oracle import TESTDATA, compare, connect

if __name__ == "__main__":
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    folder = f"{TESTDATA}/sf{scale}"
    spark = build_session()
    con = connect(folder)
    oracles, bad = oracle_sql(), []
    for key, run in queries().items():
        if prefixes and not key.startswith(prefixes):
            continue
        begun = time.time()
        try:
            df = run(spark, folder)
            diff = compare(df, con, oracles[key]) if key in oracles else f"rows only: {df.count()}"
        except Exception as error:  # report and go on
            diff = f"{type(error).__name__}: {str(error)[:700]}"
        note = "ok" if diff is None else diff
        if diff is not None and not diff.startswith("rows only"):
            bad.append(key)
        print(f"{key:34s} {time.time() - begun:6.2f}s {note}", flush=True)
    print(f"{len(bad)} differ: {bad}")
