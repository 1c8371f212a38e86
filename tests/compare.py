"""Run registered queries and their SQL side by side and compare all rows.

As a script: ``python tests/compare.py <sf_dir> [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from heatloom.plans.catalogue import ORACLES, QUERIES  # noqa: E402
from heatloom.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(root: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([columns[i] for i in order]), sorted(
        tuple(_cell(row[i]) for i in order) for row in rows)


def difference(name: str, spark, con, root: str) -> str | None:
    """None when both sides agree, else a short description."""
    frame = QUERIES[name](spark, root)
    got = canonical(frame.columns, frame.collect())
    cursor = con.execute(ORACLES[name])
    want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    extra, missing = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    return (f"rows {len(got[1])} vs {len(want[1])}; {len(extra)} only in Spark {list(extra)[:2]}; "
            f"{len(missing)} only in SQL {list(missing)[:2]}")


def main(root: str, names: list[str]) -> int:
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(root), 0
    for name in names or list(QUERIES):
        start = time.time()
        try:
            if name in ORACLES:
                problem = difference(name, spark, con, root)
            else:
                problem, frame = None, QUERIES[name](spark, root)
                rows = frame.collect()
                print("    ", len(rows), "rows", frame.columns, str(rows[:2])[:300])
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s", flush=True)
        if problem:
            print("    ", problem[:900])
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
