"""Runs registered queries beside their SQL twins in DuckDB: ``python -m queries.check [sf_dir] [name-prefix...]``."""

from __future__ import annotations

import datetime as dt
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _value(v: object) -> str:
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    return repr(v)


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple[str, ...]]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


def difference(left: tuple, right: tuple) -> str | None:
    """What differs between two canonical results, or None."""
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} vs {len(right[1])}"
    wrong = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    if wrong:
        return f"{len(wrong)} rows differ, first {str(wrong[0])[:700]}"
    return None


def compare(spark, con, fn, sql: str, sf: str) -> str | None:
    df = fn(spark, sf)
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = canonical([d[0] for d in cur.description], cur.fetchall())
    return difference(ours, theirs)


def main(argv: list[str]) -> int:
    from queries import ORACLES, QUERIES
    from tabulens.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    bad = 0
    for name, fn in QUERIES.items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, fn, ORACLES[name], sf)
            else:
                n = fn(spark, sf).count()
                problem = None if n else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:400]}"
        bad += problem is not None
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
