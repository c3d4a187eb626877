"""Runs registered queries against their DuckDB twins and prints differences.

    python -m checks.compare [--sf 0.01 | --folder DIR] [query ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from glob import glob
from pathlib import Path

import duckdb
import pandas as pd

from checks.oracles import all_sql
from checks.queries import registered
from pulseline.session import local_session


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    cells = frame.astype(object).where(frame.notna(), None)
    return sorted((tuple(float(v) if isinstance(v, float) else v for v in row)
                   for row in cells.itertuples(index=False, name=None)), key=repr)


def differences(mine: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} != {sorted(theirs.columns)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} != {len(theirs)}"
    a, b = normal(mine), normal(theirs)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, e.g. {bad[0]}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--folder")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = args.folder or f"/root/testdata/sf{args.sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(folder), all_sql(), 0
    for name, run in registered().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        print(f"-- {name}", file=sys.stderr, flush=True)
        try:
            mine = run(spark, folder).toPandas()
            middle = time.time()
            if name not in sql:
                print(f"{name}: {len(mine)} rows, no twin ({middle - start:.1f}s)", flush=True)
                continue
            problem = differences(mine, con.execute(sql[name]).df())
            spent = f"({len(mine)} rows, spark {middle - start:.1f}s, duckdb {time.time() - middle:.1f}s)"
        except Exception as error:  # noqa: BLE001
            problem, spent = str(error)[:400], ""
        failed += problem is not None
        print(f"{name}: {'ok' if problem is None else problem} {spent}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main())
