"""Compare registered Spark queries with their SQL twins: python check.py [sf] [name-prefix...]."""

from __future__ import annotations

import sys
import time

import duckdb

from sessionlens.catalog import load
from sessionlens.catalog.registry import ORACLE, QUERIES
from sessionlens.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    root = f"/root/testdata/sf{sf}"
    load()
    names = [n for n in QUERIES if not prefixes or any(n.startswith(p) or QUERIES[n].__module__.endswith(p) for p in prefixes)]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                  "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{root}/{table}.parquet'")
    bad = 0
    for name in names:
        begin = time.time()
        try:
            frame = QUERIES[name](spark, root)
            columns = sorted(frame.columns)
            got = [tuple(normal(v) for v in row) for row in frame.select(*columns).collect()]
            took = time.time() - begin
            if name not in ORACLE:
                print(f"{'ROWS' if got else 'EMPTY'} {name} {len(got)} {took:.2f}s", flush=True)
                continue
            begin = time.time()
            result = db.execute(ORACLE[name])
            found = [d[0] for d in result.description]
            rows = result.fetchall()
            sql_took = time.time() - begin
            if sorted(found) != columns:
                print(f"COLS {name} spark={columns} sql={sorted(found)}", flush=True)
                bad += 1
                continue
            types = {d[0]: str(d[1]) for d in result.description}
            odd = [c for c in columns if "HUGEINT" in types[c] or "DECIMAL" in types[c]]
            pick = [found.index(c) for c in columns]
            want = [tuple(normal(row[i]) for i in pick) for row in rows]
            key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
            got.sort(key=lambda r: repr(r)); want.sort(key=lambda r: repr(r))
            if got == want:
                flag = "OK   " if got else "OKEMPTY"
                print(f"{flag} {name} {len(got)} rows {took:.2f}s sql {sql_took:.2f}s {'TYPE ' + str(odd) if odd else ''}",
                      flush=True)
            else:
                bad += 1
                print(f"DIFF {name} spark={len(got)} sql={len(want)} cols={columns}", flush=True)
                extra = [r for r in got if r not in set(want)][:3]
                lack = [r for r in want if r not in set(got)][:3]
                print("   spark only:", extra, "\n   sql only:  ", lack, flush=True)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL {name} {type(error).__name__}: {str(error)[:900]}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
