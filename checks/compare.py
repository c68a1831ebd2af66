"""Run registered queries beside their SQL twins and report differences.

    python -m checks.compare <sf_dir> [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    return repr(v) if isinstance(v, (bool, int)) or v is None else str(v)


def table(rows, names) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both results hold the same rows, else what differs."""
    names, rows = spark_df.columns, spark_df.collect()
    cur = con.execute(sql)
    other_names = [d[0] for d in cur.description]
    other = cur.fetchall()
    if sorted(names) != sorted(other_names):
        return f"columns {sorted(set(names) ^ set(other_names))}"
    a, b = table(rows, names), table(other, other_names)
    if a == b:
        return None
    left, right = set(a) - set(b), set(b) - set(a)
    return f"rows {len(a)} vs {len(b)}; cols {sorted(names)}; only spark {sorted(left)[:2]}; only sql {sorted(right)[:2]}"


def main(sf_dir: str, only: list[str]) -> int:
    from checks.oracle import oracle
    from checks.spark_queries import QUERIES
    from tallyguard.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf_dir), oracle(), 0
    for name, query in QUERIES.items():
        if only and name not in only:
            continue
        started = time.time()
        try:
            df = query(spark, sf_dir)
            diff = difference(df, con, sqls[name]) if name in sqls else "no SQL"
            n = df.count() if diff is None and only else ""
        except Exception as e:  # report and go on with the next query
            diff, n = f"ERROR {type(e).__name__}: {str(e)[:600]}", ""
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {name} {time.time() - started:.1f}s {n} {diff or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
