"""Run registered queries next to their DuckDB statements.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def canonical(value):
    if value is None:
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value).lower())
    if isinstance(value, float):
        return (2, "nan" if math.isnan(value) else repr(value))
    if isinstance(value, int):
        return (3, str(value))
    return (4, str(value))


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def check(spark, con, query, sql, sf_dir):
    """Returns an empty string when both sides agree, else the difference."""
    df = query(spark, sf_dir)
    found = df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    wanted = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(set(df.columns) ^ set(names))}"
    kind_gaps = [(n, t, kinds[n]) for n, t in df.dtypes if KINDS.get(t, t) != kinds[n]]
    ours, theirs = as_rows(df.columns, found), as_rows(names, wanted)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    if ours != theirs:
        names = sorted(names)
        gaps = [(names[i], a[i], b[i]) for a, b in zip(ours, theirs)
                for i in range(len(a)) if a[i] != b[i]]
        return f"{len(gaps)} values differ, first {gaps[:4]}"
    if kind_gaps:
        return f"types differ: {kind_gaps[:6]}"
    return ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = (SparkSession.builder.master("local[8]")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in names:
        start = time.time()
        try:
            if name in oracle:
                note = check(spark, con, queries[name], oracle[name], sf_dir) or "ok"
            else:
                note = f"rows only: {len(queries[name](spark, sf_dir).collect())}"
        except Exception as error:  # report and go on with the next query
            note = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {note}", flush=True)


if __name__ == "__main__":
    main()
