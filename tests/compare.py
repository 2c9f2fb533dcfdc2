"""Run registered queries beside their SQL and compare the results.

    python -m tests.compare /root/testdata/sf0.01 agg_ cln_
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"f{round(v, 6) + 0.0:.6f}"
    if isinstance(v, int):
        return f"i{v}"
    if isinstance(v, decimal.Decimal):
        return f"d{v}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    return f"s{v}"


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("\x1f".join(cell(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def sql_rows(con, sql: str):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short description."""
    a_cols, a = canon(*spark_rows(df))
    b_cols, b = canon(*sql_rows(con, sql))
    if a_cols != b_cols:
        return f"columns {sorted(set(a_cols) ^ set(b_cols))}"
    if a == b:
        return None if a else "both empty"
    in_a, in_b = set(a), set(b)
    left = [x for x in a if x not in in_b][:2]
    right = [x for x in b if x not in in_a][:2]
    return f"rows {len(a)} vs {len(b)} cols={a_cols}\n   spark {left}\n   sql   {right}"


def main() -> None:
    from tests.session import make_session

    import __spark_entry__ as entry

    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:]) or ("",)
    spark = make_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = done = 0
    for key, plan in queries.items():
        if not key.startswith(prefixes):
            continue
        t = time.time()
        try:
            if key in oracles:
                problem = difference(plan(spark, sf_dir), con, oracles[key])
            else:
                n = plan(spark, sf_dir).count()
                problem = None if n else "no rows"
                key += f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        done += 1
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - t:5.1f}s {key}" + (f"\n   {problem}" if problem else ""), flush=True)
    print(f"{done - bad}/{done} agree")


if __name__ == "__main__":
    main()
