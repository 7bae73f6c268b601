"""Run registered queries in Spark and their SQL in DuckDB, and compare rows without regard to order.

``python tools/compare.py [sf_dir] [name prefix ...]``
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET memory_limit = '8GB'; SET max_temp_directory_size = '2GB'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


# Spark types and the DuckDB types with the same meaning.
SAME_TYPES = {"string": "VARCHAR", "double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "date": "DATE"}


def compare(spark, con, sf_dir: str, name: str, run, sql: str | None) -> str:
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if sql is None:
        return f"rows only: {len(rows)}"
    relation = con.sql(sql)
    types = dict(zip(relation.columns, map(str, relation.types)))
    if sorted(types) != columns:
        return f"FAIL columns {columns} vs {sorted(types)}"
    wrong = [(f.name, f.dataType.simpleString(), types[f.name]) for f in df.schema if SAME_TYPES.get(f.dataType.simpleString()) != types[f.name]]
    expected = relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    left, right = (sorted(map(repr, x)) for x in (rows, expected))
    if left == right:
        return f"ok {len(rows)}" if not wrong else f"FAIL types {wrong}"
    a, b = set(left), set(right)
    only_spark, only_sql = sorted(a - b)[:3], sorted(b - a)[:3]
    return f"FAIL rows {len(left)} vs {len(right)}, differing {len(a - b)}; columns {columns}; spark {only_spark}; sql {only_sql}; types {wrong}"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    from panelloom.registered import REGISTERED
    from panelloom.session import get_spark

    spark = get_spark("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, q in REGISTERED.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            outcome = compare(spark, con, sf_dir, name, q.run, q.sql)
        except Exception as error:
            outcome = f"FAIL {type(error).__name__}: {str(error)[:1500]}"
        failed += outcome.startswith("FAIL")
        print(f"{name:40s} {time.time() - start:6.2f}s {outcome}", flush=True)
    print(f"{failed} failed")
    spark.stop()


if __name__ == "__main__":
    main()
