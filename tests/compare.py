"""Run a registered query beside its SQL and compare the results.

``python tests/compare.py SF_DIR [key ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if hasattr(v, "as_integer_ratio"):
        return float(v) + 0.0
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([_plain(r[i]) for i in order] for r in data), key=lambda r: [(v is None, str(v)) for v in r])


def difference(got_names, got, want_names, want) -> str | None:
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} vs {sorted(want_names)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = rows(got_names, got), rows(want_names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]}" if bad else None


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").appName("compare")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf: str, keys: list[str]) -> int:
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    spark, con = session(), duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for k in keys or list(queries):
        t = time.time()
        try:
            df = queries[k](spark, sf)
            got, names = df.collect(), df.columns
        except Exception as e:
            failed += 1
            print(f"ERR  {k}: {str(e)[:600]}", flush=True)
            continue
        took = time.time() - t
        if k not in oracles:
            print(f"rows {k}: {len(got)} rows {took:.1f}s", flush=True)
            continue
        t = time.time()
        try:
            res = con.execute(oracles[k])
            want_names = [d[0] for d in res.description]
            diff = difference(names, got, want_names, res.fetchall())
        except Exception as e:
            diff = f"oracle error {str(e)[:600]}"
        failed += diff is not None
        print(f"{'ok  ' if diff is None else 'FAIL'} {k}: {len(got)} rows {took:.1f}s sql {time.time() - t:.1f}s"
              + (f" -- {diff[:900]}" if diff else ""), flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
