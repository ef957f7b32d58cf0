"""Compares registered queries with their SQL text on one scale of the test tables."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r)
    )


def difference(con, spark, sf: str, build, sql: str) -> str | None:
    """None when both results are equal, else what differs."""
    got_df = build(spark, sf)
    got = canonical(got_df.columns, [tuple(r) for r in got_df.collect()])
    rel = con.sql(sql)
    want = canonical(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    spark_types = {f.name: f.dataType.simpleString() for f in got_df.schema}
    names = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    for name, kind in zip(rel.columns, rel.types):
        if names.get(spark_types[name]) != str(kind):
            return f"type of {name}: {spark_types[name]} != {kind}"
    if got[1] != want[1]:
        only_got = [r for r in got[1] if r not in set(want[1])][:3]
        only_want = [r for r in want[1] if r not in set(got[1])][:3]
        return f"{len(got[1])} rows != {len(want[1])}; only Spark {only_got}; only SQL {only_want}"
    return None


def main() -> None:
    import __spark_entry__ as e
    from tests.session import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, bad = make_session(), connect(sf), 0
    for name, build in e.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            sql = e.oracle_sql().get(name)
            if sql is None:
                problem, note = None, f"{build(spark, sf).count()} rows, no SQL"
            else:
                problem, note = difference(con, spark, sf, build, sql), f"{len(con.sql(sql).fetchall())} rows"
        except Exception as err:  # report and go on with the other queries
            problem, note = f"{type(err).__name__}: {str(err)[:1500]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or note}", flush=True)
    print(f"{bad} failures")


if __name__ == "__main__":
    main()
