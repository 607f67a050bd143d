"""Run registered queries against their SQL in DuckDB: python tests/oracle_check.py [names…]."""

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "0.0" if v == 0 and math.copysign(1, v) > 0 else repr(v)
    return str(v)


def bag(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    left = bag([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return True, f"{sum(left.values())} rows, no SQL"
    rel = con.sql(sql)
    cols, types = rel.columns, dict(zip(rel.columns, map(str, rel.types)))
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(set(cols) ^ set(df.columns))}"
    want = {"bigint": ("BIGINT", "INTEGER"), "int": ("INTEGER",), "double": ("DOUBLE",), "string": ("VARCHAR",), "boolean": ("BOOLEAN",)}
    bad = [(c, t, types[c]) for c, t in df.dtypes if types[c] not in want.get(t, ())]
    right = bag(rel.fetchall(), cols)
    if bad:
        return False, f"types {bad}"
    if left != right:
        return False, (f"{sum(left.values())}/{sum(right.values())} rows, cols {sorted(cols)}; only spark "
                       f"{list((left - right).items())[:2]}; only sql {list((right - left).items())[:2]}")
    note = "" if left else "  EMPTY"
    return True, f"{sum(left.values())} rows{note}"


def main(names, sf_dir):
    import __spark_entry__ as entry
    from paydrift.session import build_session
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                  "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(sf_dir), []
    qs, os_ = entry.queries(), entry.oracle_sql()
    for n in [q for q in qs if not names or any(q == x or (x.endswith("*") and q.startswith(x[:-1])) for x in names)]:
        t = time.time()
        try:
            ok, msg = compare(spark, con, n, qs[n], os_.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001 - a report of every query is wanted
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
        print("ok  " if ok else "FAIL", n, msg, f"{time.time() - t:.1f}s", flush=True)
        if not ok:
            failed.append(n)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:], os.environ.get("CHECK_SF", "/root/testdata/sf0.01"))
