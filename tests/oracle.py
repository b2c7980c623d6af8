"""Runs registered queries next to their SQL and compares rows regardless of order."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def differences(df, con, sql: str) -> list[str]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    order = sorted(names)
    expected = Counter(tuple(_plain(row[names.index(c)]) for c in order) for row in result.fetchall())
    actual = Counter(tuple(_plain(row[c]) for c in order) for row in df.collect())
    problems = []
    if sum(expected.values()) != sum(actual.values()):
        problems.append(f"rows {sum(actual.values())} != {sum(expected.values())}")
    missing, extra = expected - actual, actual - expected
    if missing or extra:
        problems.append(f"{order}")
        problems += [f"missing {sorted(missing, key=str)[:3]}", f"extra {sorted(extra, key=str)[:3]}"]
    return problems


if __name__ == "__main__":
    from docweave import catalog
    from docweave.session import local_session

    sf = "/root/testdata/sf0.01"
    spark = local_session(8)
    con = connect(sf)
    wanted = sys.argv[1:]
    for name, fn in catalog.load().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            if name not in catalog.check_sql():
                print(f"{name}: rows {len(fn(spark, sf).collect())} ({time.time() - started:.1f}s)", flush=True)
                continue
            problems = differences(fn(spark, sf), con, catalog.check_sql()[name])
            n = con.execute(f"SELECT count(*) FROM ({catalog.check_sql()[name]})").fetchone()[0]
            print(f"{name}: {'OK' if not problems else 'DIFF'} rows={n} ({time.time() - started:.1f}s)", flush=True)
            for p in problems:
                print("   ", p[:900])
        except Exception as exc:  # noqa: BLE001
            print(f"{name}: ERROR {str(exc)[:1500]}", flush=True)
