"""Run queries against their SQL: python tests/verify.py SF_DIR [NAME...]. Prints one line for each."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x.item() if hasattr(x, "item") else x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    result = con.execute(sql)
    want_names = [c[0] for c in result.description]
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} and {sorted(want_names)}"
    want = rows(want_names, result.fetchall())
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; {next((p for p in zip(got, want) if p[0] != p[1]), None)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w and not all(a == b or isinstance(a, float) and isinstance(b, int | float) and abs(a - b) < 2e-6 for a, b in zip(g, w, strict=True))]
    return f"{len(bad)} of {len(got)} rows differ: {bad[0]}" if bad else ""


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf, names = sys.argv[1], sys.argv[2:]
    con, sqls, queries = duck(sf), e.oracle_sql(), e.queries()
    for name in names or queries:
        t = time.time()
        try:
            said = compare(spark, con, name, queries[name], sqls[name], sf) or "equal" if name in sqls else f"{queries[name](spark, sf).count()} rows, no SQL"
        except Exception as x:
            said = "error: " + str(x)[:700]
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
