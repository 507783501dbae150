"""Run registered queries in Spark and their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, int):
            return repr(float(v)) if abs(v) < 2**53 else str(v)
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return _canonical([tuple(r) for r in df.collect()], df.columns)


def duck_rows(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return _canonical(cursor.fetchall(), columns)


def difference(df, con, sql) -> str | None:
    """None when columns and rows are the same, else what differs."""
    columns, rows = spark_rows(df)
    want_columns, want = duck_rows(con, sql)
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    if rows == want:
        return None
    only = [r for r in rows if r not in set(want)][:3]
    missing = [r for r in want if r not in set(rows)][:3]
    return f"{len(rows)} rows against {len(want)}; only Spark {only}; only SQL {missing}; columns {columns}"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, statements = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in statements:
                found = difference(df, con, statements[name])
            else:
                found = f"rows only: {len(df.collect())}"
        except Exception as e:  # keep going: this is a report
            found = f"FAILED {type(e).__name__}: {str(e)[:1500]}"
        bad += found is not None and not found.startswith("rows only")
        print(f"{name:28s} {time.time() - start:6.1f}s  {found or 'same'}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
