"""Compare registered queries with their DuckDB SQL: ``python -m tests.oracle [--sf 0.01] [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
import pyarrow as pa
from pyspark.sql import SparkSession


def make_spark(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def make_duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    return str(t)


def _key(row):
    return tuple((v is not None, str(type(v)), round(v, 6) if isinstance(v, float) else v) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def compare(spark_table: pa.Table, duck_table: pa.Table) -> str | None:
    """None when both results hold the same rows, else a short description of the difference."""
    names = sorted(spark_table.column_names)
    if names != sorted(duck_table.column_names):
        return f"columns {names} <> {sorted(duck_table.column_names)}"
    s, d = spark_table.select(names), duck_table.select(names)
    types = [(n, _kind(a.type), _kind(b.type)) for n, a, b in zip(names, s.schema, d.schema)]
    bad = [t for t in types if t[1] != t[2]]
    if bad:
        return f"types {bad}"
    if s.num_rows != d.num_rows:
        return f"rows {s.num_rows} <> {d.num_rows}"
    rows_s = sorted((tuple(r[n] for n in names) for r in s.to_pylist()), key=_key)
    rows_d = sorted((tuple(r[n] for n in names) for r in d.to_pylist()), key=_key)
    diff = [(a, b) for a, b in zip(rows_s, rows_d) if not all(_same(x, y) for x, y in zip(a, b))]
    if diff:
        return f"{len(diff)} rows differ, columns {names}; first:\n   spark {diff[0][0]}\n   duck  {diff[0][1]}"
    return None


def main(argv: list[str]) -> int:
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    from __spark_entry__ import oracle_sql, queries
    from pacetrace.functions.storage import clear_scratch

    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_spark(), make_duck(sf_dir)
    oracles, failed = oracle_sql(), []
    todo = {n: q for n, q in queries().items() if not argv or any(a in n for a in argv)}
    for name, run in todo.items():
        t0 = time.time()
        try:
            got = run(spark, sf_dir).toArrow()
            t1 = time.time()
            if name in oracles:
                want = con.sql(oracles[name]).to_arrow_table()
                problem = compare(got, want)
            else:
                problem = None
            status = "FAIL " + problem if problem else ("ok" if name in oracles else "rows-only")
            print(f"{name:34s} {got.num_rows:8d} rows {t1 - t0:6.2f}s / {time.time() - t1:5.2f}s  {status}", flush=True)
            if problem or got.num_rows == 0 and name not in oracles:
                failed.append(name)
            clear_scratch(spark)
        except Exception as exc:  # report and go on with the next query
            print(f"{name:34s} ERROR {str(exc)[:1500]}", flush=True)
            failed.append(name)
    print(f"{len(todo) - len(failed)} of {len(todo)} good; not good: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
