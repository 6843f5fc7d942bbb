"""The headline queries on one machine without Spark: their SQL twins in DuckDB, and plain pandas for some.

``python benchmarks/single_node.py [sf_dir]`` prints one JSON line; best of three runs, files read in every run.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from collections import Counter

import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from queries import ORACLES  # noqa: E402
from queries.check import connect  # noqa: E402

L4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def pandas_queries(sf: str) -> dict:
    def read(name: str, cols: list[str] | None = None) -> pd.DataFrame:
        return pd.read_parquet(f"{sf}/{name}.parquet", columns=cols)

    def zscore(s: pd.Series) -> int:
        return int((((s - s.mean()) / s.std()).abs() > 3).sum())

    def profile() -> list:
        df = read("orders")
        numeric = df.select_dtypes("number").columns
        return [
            (c, df[c].isna().sum(), df[c].nunique(), *((df[c].min(), df[c].max(), df[c].mean(), df[c].median(), df[c].std(), zscore(df[c])) if c in numeric else ()))
            for c in df
        ]

    def clip() -> pd.Series:
        s = read("events", ["value"])["value"]
        q1, q3 = s.quantile(0.25), s.quantile(0.75)
        return s.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))

    def clean() -> pd.Series:
        t = read("documents", ["text"])["text"].str.strip().str.lower()
        return t.map(lambda s: re.sub(r"\d+", "", re.sub(r"[^\w\s]", "", s)))

    def words() -> Counter:
        out: Counter = Counter()
        for t in read("documents", ["text"])["text"]:
            out.update(re.findall(r"\w+", t.lower()))
        return out

    def ffill() -> pd.DataFrame:
        df = read("events", ["user_id", "event_id", "ts"]).sort_values(["user_id", "event_id"])
        df["ts"] = df["ts"].where(df["event_id"] % 4 > 0)
        return df.assign(ts=df.groupby("user_id").ts.ffill())

    return {
        "p02_missing_counts": lambda: read("orders").isna().sum(),
        "p03_duplicate_count": lambda: read("events", ["user_id", "event_type"]).duplicated().sum(),
        "p04_distinct_counts": lambda: read("part").nunique(),
        "p07_top_values": lambda: [read("part", [c])[c].value_counts().head(5) for c in ("p_name", "p_brand", "p_type")],
        "p10_describe_numeric": lambda: read("lineitem", L4).describe(),
        "p14_profile_text": lambda: read("documents", ["text"])["text"].map(lambda t: (len(t), len(t.split()))),
        "p23_profile_columns": profile,
        "k02_dedupe": lambda: read("events", ["user_id", "event_type"]).drop_duplicates(),
        "k08_forward_fill": ffill,
        "k09_iqr_clip": clip,
        "k14_clean_text": clean,
        "a02_correlation": lambda: read("lineitem", L4).corr(),
        "a09_compare_groups": lambda: read("lineitem", ["l_returnflag", "l_extendedprice"]).groupby("l_returnflag").l_extendedprice.agg(["mean", "count", "std"]),
        "a17_crosstab": lambda: pd.crosstab(*[read("lineitem", [c])[c] for c in ("l_returnflag", "l_linestatus")]),
        "t01_word_freq": words,
    }


def best(fn) -> float:
    times = []
    for _ in range(3):
        start = time.perf_counter()
        fn()
        times.append(time.perf_counter() - start)
    return round(min(times), 4)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    con = connect(sf)
    out = {"duckdb": {n: best(lambda n=n: con.execute(ORACLES[n]).fetchall()) for n in HEADLINE if n in ORACLES}}
    out["pandas"] = {n: best(fn) for n, fn in pandas_queries(sf).items()}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
