"""Runs queries in Spark and their SQL in DuckDB and says where they differ."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

NAMES = "region nation customer supplier part orders lineitem events documents embeddings functions_raw function_meta split_index prediction cs raw_records split_share pack_capacity mix_target".split()


def connect(folder: str):
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for n in NAMES:
        c.execute(f"create view {n} as select * from read_parquet('{folder}/{n}.parquet')")
    return c


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows(frame_rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in frame_rows), key=repr)


def compare(spark, con, folder: str, name: str) -> str:
    """Empty if the query and its SQL give the same columns, row count and values."""
    df = entry.queries()[name](spark, folder)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    want = rows(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}: {[x for x in got if x not in want][:2]} {[x for x in want if x not in got][:2]}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{a} against {b}"
    return ""


if __name__ == "__main__":
    from codeloom.session import local_session, ship

    folder = sys.argv[1]
    spark = ship(local_session(8))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in sys.argv[2:] or entry.oracle_sql():
        t = time.time()
        try:
            said = compare(spark, con, folder, name)
        except Exception as e:
            said = f"{type(e).__name__} {str(e)[:400]}"
        print("ok  " if not said else "DIFF", name, round(time.time() - t, 1), said, flush=True)
