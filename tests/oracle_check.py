"""Compare every registered query with its SQL on DuckDB.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set enable_progress_bar = false")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal(frame):
    """Rows as a sorted list, columns by name, so order does not matter."""
    import pandas as pd

    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).startswith("datetime") or frame[c].map(type).astype(str).str.contains("date").any():
            frame[c] = pd.to_datetime(frame[c]).astype("datetime64[us]")
        elif frame[c].dtype == "float32":
            frame[c] = frame[c].astype("float64")
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in frame.itertuples(index=False)]
    return list(frame.columns), sorted(rows, key=repr)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    import __spark_entry__ as entry

    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    got_cols, got_rows = normal(got)
    want_cols, want_rows = normal(want)
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if len(got_rows) != len(want_rows):
        return f"{len(got_rows)} rows vs {len(want_rows)}"
    wrong = [(g, w) for g, w in zip(got_rows, want_rows, strict=True) if g != w]
    return f"{len(wrong)} of {len(got_rows)} rows, first {wrong[0]}" if wrong else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for q in sys.argv[2:] or entry.queries():
        t = time.time()
        try:
            diff = compare(session, con, q, sf)
        except Exception as err:  # noqa: BLE001 - report and go on with the next query
            diff = f"{type(err).__name__}: {str(err)[:1500]}"
        bad += diff is not None
        print(f"{'ok  ' if diff is None else 'DIFF'} {q:24s} {time.time() - t:6.1f}s {diff or ''}", flush=True)
    print("all equal" if not bad else f"{bad} differ")
