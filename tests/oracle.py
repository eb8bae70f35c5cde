"""Run registered queries and their SQL twins side by side.

    python tests/oracle.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str | None:
    """None when both results hold the same rows, else what differs."""
    found = df.collect()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    wide = [n for n, k in kinds.items() if "HUGEINT" in k or "[]" in k or "TIMESTAMP" in k or "DECIMAL" in k]
    if wide:
        return f"oracle types: {[(n, kinds[n]) for n in wide]}"
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    expected = cursor.fetchall()
    a, b = rows_of(df.columns, found), rows_of(names, expected)
    if a == b:
        return None
    return f"rows {len(found)} against {len(expected)}; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in [n for n in queries if not args or n in args or any(a.endswith("*") and n.startswith(a[:-1]) for a in args)]:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = differences(df, con, oracles[name]) if name in oracles else (None if df.collect() else "no rows")
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s{'' if name in oracles else ' (rows only)'} {problem or ''}"[:1500], flush=True)
    print(f"{bad} of {len(queries)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
