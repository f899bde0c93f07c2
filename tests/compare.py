"""Run named queries in Spark and their SQL in DuckDB and compare all rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES.split():
        if (Path(folder) / f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark, con, folder, query, sql) -> str | None:
    df = query(spark, folder)
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = _rows(got, df.columns), _rows(want, names)
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return f"{len(a)} rows vs {len(b)}; only spark ({len(only_a)}) {only_a[:2]}; only sql ({len(only_b)}) {only_b[:2]}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from tidemark.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    folder = sys.argv[1]
    con, sqls, qs = connect(folder), oracle_sql(), queries()
    bad = 0
    for name in sys.argv[2:] or list(qs):
        t = time.time()
        try:
            if name not in sqls:
                print(f"{name:28s} rows only: {qs[name](spark, folder).count()} {time.time() - t:.1f}s")
                continue
            diff = difference(spark, con, folder, qs[name], sqls[name])
        except Exception as e:  # report and go on
            diff = f"{type(e).__name__}: {str(e)[:500]}"
        bad += diff is not None
        print(f"{name:28s} {'ok' if diff is None else 'DIFF ' + diff} {time.time() - t:.1f}s", flush=True)
    print("differing:", bad)
