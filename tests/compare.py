"""Runs catalogue queries against their SQL on DuckDB.

``python tests/compare.py <folder> [name ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _kind(series: pd.Series) -> str:
    kind = series.dtype.kind
    return "i" if kind in "iu" else kind


def _canonical(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows[sorted(rows.columns)].copy()
    for c in rows.columns:
        if _kind(rows[c]) in "fi":
            rows[c] = rows[c].astype("float64").round(5)
        else:
            rows[c] = rows[c].map(lambda v: None if pd.isna(v) else str(v))
    return rows.sort_values(list(rows.columns), na_position="first").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, otherwise what differs first."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    a, b = _canonical(got), _canonical(want)
    for c in a.columns:
        if _kind(a[c]) == "f" and _kind(b[c]) == "f":
            off = ~((a[c] - b[c]).abs().le(2e-5) | (a[c].isna() & b[c].isna()))
        else:
            off = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if off.any():
            i = off.idxmax()
            return f"{int(off.sum())} of {c}: {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    from matchlake.plans import catalog, oracles

    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    wanted, sql = catalog.queries(), oracles.oracle_sql()
    print("without SQL:", sorted(set(wanted) - set(sql)), "SQL only:", sorted(set(sql) - set(wanted)))
    bad = []
    for name in names or wanted:
        begun = time.time()
        try:
            got = wanted[name](spark, folder).toPandas()
            spent = time.time() - begun
            if name not in sql:
                print(f"rows  {name:22} {spent:6.2f}s {len(got)}", flush=True)
                continue
            begun = time.time()
            want = con.execute(sql[name]).df()
            told = difference(got, want)
            kinds = [
                f"{c}:{_kind(got[c])}/{_kind(want[c])}"
                for c in got.columns
                if c in want.columns and _kind(got[c]) != _kind(want[c])
            ]
            print(
                f"{'ok   ' if told is None else 'DIFF '} {name:22} {spent:6.2f}s "
                f"duck {time.time() - begun:6.2f}s {len(got)} {' '.join(kinds)} {told or ''}",
                flush=True,
            )
            if told:
                bad.append(name)
        except Exception as error:  # noqa: BLE001 - report and go on
            print(f"FAIL  {name:22} {str(error)[:600]}", flush=True)
            bad.append(name)
    print("not equal:", bad)


if __name__ == "__main__":
    main()
