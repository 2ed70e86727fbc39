"""Runs a check in Spark and in DuckDB and compares the rows, order aside.

    python -m parcelry_checks.compare <sf_dir> [check ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession

from parcelry_checks.oracle import oracle_sql
from parcelry_checks.queries import drop_databases, queries


def local_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("parcelry")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        # Keeps all cores busy on small tables, and lets Spark join by hash
        # where it has seen that every partition fits.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "32k")
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def _rows(columns: list[str], rows: list[tuple]) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(row[i] for i in order) for row in rows)


def difference(frame: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between the two results, ``None`` if nothing does."""
    cursor = connection.execute(sql)
    sql_columns = [c[0] for c in cursor.description]
    if sorted(frame.columns) != sorted(sql_columns):
        return f"columns {sorted(frame.columns)} and {sorted(sql_columns)}"
    expected = _rows(sql_columns, cursor.fetchall())
    found = _rows(frame.columns, [tuple(row) for row in frame.collect()])
    if found == expected:
        return None
    missing, extra = expected - found, found - expected
    return (
        f"{found.total()} rows, expected {expected.total()}; "
        f"missing {missing.total()}: {list(missing)[:2]}, extra {extra.total()}: {list(extra)[:2]}"
    )


def main(sf_dir: str, names: list[str]) -> int:
    spark, connection = local_session(), oracle_connection(sf_dir)
    checks, sql = queries(), oracle_sql()
    failed = 0
    for name in names or checks:
        started = time.perf_counter()
        try:
            frame = checks[name](spark, sf_dir)
            problem = difference(frame, connection, sql[name]) if name in sql else "no SQL"
        except Exception as error:  # keep going, the list of all failures is the point
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{name:28s} {time.perf_counter() - started:6.2f}s {problem or 'equal'}", flush=True)
        drop_databases(spark)
    print(f"{failed} of {len(names or checks)} differ")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
