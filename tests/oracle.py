"""Side-by-side comparison of registered queries with their SQL on the driver tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return ("nan",) if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, sf_dir, queries, oracles):
    """None when both sides agree, else a short description of the difference."""
    df = queries[name](spark, sf_dir)
    left_cols, left = normal_rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in oracles:
        return None if left else "no rows"
    cur = con.execute(oracles[name])
    right_cols, right = normal_rows([d[0] for d in cur.description], cur.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}; {left[:2]} / {right[:2]}"
    if not left:
        return "no rows"
    for a, b in zip(left, right):
        for c, x, y in zip(left_cols, a, b):
            if x != y or type(x) is not type(y):
                return f"{c}: {x!r} != {y!r} in\n   {dict(zip(left_cols, a))}\n   {dict(zip(left_cols, b))}"
    return None


if __name__ == "__main__":
    from riskpanel import catalogue
    from riskpanel.session import build_session

    catalogue.load_all()
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:] or list(catalogue.QUERIES)
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("oracle", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for q in [n for n in catalogue.QUERIES if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]:
        start = time.time()
        try:
            problem = compare(spark, con, q, sf_dir, catalogue.QUERIES, catalogue.ORACLES)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {q} {time.time() - start:.1f}s {'' if q in catalogue.ORACLES else '(rows only)'}",
              problem or "", flush=True)
        if problem:
            bad.append(q)
    print(len(bad), "bad:", bad)
