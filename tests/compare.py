"""Run queries and their DuckDB SQL side by side: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at if os.path.isfile(at) else at + '/*.parquet'}')")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def shaped(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    own = shaped(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    other = shaped([c[0] for c in cur.description], cur.fetchall())
    if own[0] != other[0]:
        return f"columns {own[0]} and {other[0]}"
    if own[1] != other[1]:
        a, b = set(own[1]), set(other[1])
        return f"{len(own[1])} and {len(other[1])} rows; only here {sorted(a - b, key=repr)[:3]}; only there {sorted(b - a, key=repr)[:3]}"
    return ""


def main(sf_dir: str, names: list[str]) -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, sql, bad = duck(sf_dir), e.oracle_sql(), 0
    for name, f in e.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = f(spark, sf_dir)
            if name in sql:
                said = difference(df, con, sql[name])
                n = df.count()
            else:
                n, said = df.count(), ""
            kind = "same" if name in sql else "rows"
        except Exception as x:
            kind, said, n = "error", " ".join(str(x).split())[:400], -1
        bad += bool(said)
        print(f"{'BAD ' if said else ''}{kind} {name} {n} rows {time.time() - t:.1f} s {said}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
