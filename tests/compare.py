"""Run registered queries beside their SQL in DuckDB and compare whole results.

``python tests/compare.py [folder] [key-prefix ...]`` prints one line per query.
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def compare(spark, con, folder, query, sql):
    """(rows, None) if the results agree, else (rows, what differs)."""
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)
    if sql is None:
        return len(got), None
    relation = con.sql(sql)
    if sorted(relation.columns) != names:
        return len(got), f"columns {names} / {sorted(relation.columns)}"
    order = [relation.columns.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in order) for r in relation.fetchall()), key=repr)
    types = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {n: (t, types[n]) for n, t in df.dtypes if same.get(t, types[n]) != types[n]}
    if len(got) != len(want):
        return len(got), f"rows {len(got)} / {len(want)}; types {odd}"
    for a, b in zip(got, want):
        if a != b:
            return len(got), f"{str(a)[:300]} / {str(b)[:300]}"
    return len(got), (f"types {odd}" if odd else None)


def main():
    from themeloom.catalog import ORACLES, QUERIES
    from themeloom.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = [k for k in QUERIES if not sys.argv[2:] or k.startswith(tuple(sys.argv[2:]))]
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    bad = 0
    for key in keys:
        start = time.time()
        sql = ORACLES.get(key)
        sql = sql() if callable(sql) else sql
        try:
            count, problem = compare(spark, con, folder, QUERIES[key], sql)
        except Exception as error:  # report and go on with the next query
            count, problem = -1, f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        state = "ok  " if problem is None and sql else "rows" if problem is None else "BAD "
        print(f"{state} {key:32s} {count:8d} {time.time() - start:6.1f}s {problem or ''}", flush=True)
    print("bad:", bad, "of", len(keys))


if __name__ == "__main__":
    main()
