"""Run registered queries beside their SQL and print what differs: python tests/check_queries.py [sf_dir] [name…]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from tests.compare import TABLES, difference


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from tidemill.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql, bad = oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            rows = df.toPandas()
            took = time.time() - start
            if name in sql:
                found = difference(rows, con.execute(sql[name]).df())
            else:
                found = None if len(rows) else "no rows"
        except Exception as exc:
            took, found, rows = time.time() - start, f"{type(exc).__name__}: {str(exc)[:1500]}", []
        bad += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name:28s} {took:6.2f}s rows={len(rows)} {'' if name in sql else '(rows only)'} {found or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
