"""Runs registered queries against their oracles: python tests/oracle.py [sf] [name ...]."""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads=4")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame, digits: int | None = 6):
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        out = []
        for v in row:
            if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
                out.append("NULL")
            elif isinstance(v, bool) or type(v).__name__ == "bool_" or type(v).__name__ == "bool":
                out.append(str(bool(v)))
            elif isinstance(v, (int, float)) or type(v).__module__ == "numpy":
                number = float(v) if not isinstance(v, str) else v
                out.append(repr(round(number, digits) + 0.0) if digits is not None else repr(number))
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def compare(spark_frame, duck_frame):
    """Empty text when equal, else what differs."""
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(duck_frame.columns)}"
    if len(spark_frame) != len(duck_frame):
        return f"rows {len(spark_frame)} / {len(duck_frame)}"
    kinds = []
    for c in spark_frame.columns:
        a, b = spark_frame[c].dtype.kind, duck_frame[c].dtype.kind
        nulls = spark_frame[c].isna().any() or duck_frame[c].isna().any()
        if a != b and "f" in (a, b) and not nulls and "O" not in (a, b) or "M" in (a, b):
            kinds.append(f"{c}: {spark_frame[c].dtype}/{duck_frame[c].dtype}")
    if kinds:
        return "types " + ", ".join(kinds)
    left, right = canonical(spark_frame), canonical(duck_frame)
    if left == right:
        left, right = canonical(spark_frame, None), canonical(duck_frame, None)
        names = sorted(spark_frame.columns)
        loose = sorted({n for a, b in zip(left, right) for n, x, y in zip(names, a, b) if x != y})
        return "~" + ",".join(loose) if loose else ""
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    names = sorted(spark_frame.columns)
    a, b = wrong[0]
    return f"{len(wrong)} of {len(left)} rows differ, first: " + str([(n, x, y) for n, x, y in zip(names, a, b) if x != y][:4])


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry
    from ventara.plans.session import local_session

    spark = local_session(8, 8)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    con = duck(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in oracles:
                print(f"rows  {name} {len(got)} rows {took:.1f}s", flush=True)
                continue
            want = con.execute(oracles[name]).df()
            verdict = compare(got, want)
        except Exception as error:  # noqa: BLE001
            verdict, took, got = str(error)[:1500], time.time() - start, []
        bad += bool(verdict) and verdict[0] != "~"
        mark = "ok   " if not verdict else "ok~  " if verdict[0] == "~" else "FAIL "
        print(f"{mark} {name} {len(got)} rows {took:.1f}s {verdict}", flush=True)
    print("failed", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
