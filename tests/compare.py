"""Run registered queries beside their SQL on DuckDB and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from decimal import Decimal

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _order(row):
    return tuple((v is not None, f"{v:.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
                 for v in row)


def normalized(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=_order)


def differences(spark_df, con, sql: str, tolerance: float = 1e-8) -> list[str]:
    left_names, left = normalized(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    right_names, right = normalized([d[0] for d in cursor.description], cursor.fetchall())
    if left_names != right_names:
        return [f"columns {left_names} vs {right_names}"]
    if len(left) != len(right):
        return [f"rows {len(left)} vs {len(right)}", f"{left[:2]} vs {right[:2]}"]
    out = []
    for a, b in zip(left, right):
        for name, x, y in zip(left_names, a, b):
            if isinstance(x, (int, float)) and isinstance(y, (int, float)):
                same = abs(x - y) <= tolerance * max(1.0, abs(x), abs(y))
            else:
                same = x == y
            if not same:
                out.append(f"{name}: {x!r} vs {y!r} in {a} | {b}")
                break
        if len(out) > 2:
            break
    return out


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tests.session import session
    sf_dir = f"/root/testdata/{argv[0]}"
    spark, con = session(), connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if argv[1:] and not any(name.startswith(p) for p in argv[1:]):
            continue
        start = time.time()
        try:
            if name in oracles:
                problems = differences(run(spark, sf_dir), con, oracles[name])
            else:
                rows = run(spark, sf_dir).collect()
                problems = [] if rows else ["no rows"]
                if argv[1:]:
                    print("   ", rows[:4])
        except Exception as error:  # noqa: BLE001 - report and go on to the next query
            problems = [f"{type(error).__name__}: {str(error)[:900]}"]
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {name} {time.time() - start:.1f}s"
              f"{'' if name in oracles else ' (rows only)'}", *problems, sep="\n     " if problems else " ", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
