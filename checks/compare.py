"""Run registered queries against their SQL: ``python -m checks.compare [sf_dir] [name prefix ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.registry import ORACLES, QUERIES
from mailloom.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows sorted."""
    frame = frame[sorted(frame.columns)]
    text = frame.astype(object).where(frame.notna(), None).map(lambda v: "NULL" if v is None else str(v))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    """Why two results differ, None if they do not."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"{len(spark_frame)} and {len(sql_frame)} rows"
    left, right = canonical(spark_frame), canonical(sql_frame)
    for column in left.columns:
        wrong = left[column] != right[column]
        if wrong.any():
            at = wrong.idxmax()
            return f"{int(wrong.sum())} values of {column}, first {left[column][at]!r:.300} and {right[column][at]!r:.300}"
    return None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = tuple(sys.argv[2:])
    spark = build_session("compare", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck_tables(sf_dir)
    failures = 0
    for name, run in QUERIES.items():
        if wanted and not name.startswith(wanted):
            continue
        start = time.time()
        try:
            frame = run(spark, sf_dir)
            got = frame.toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name} {len(got)} {took:.1f}s")
                continue
            start = time.time()
            want = con.sql(ORACLES[name])
            types = {f.name: f.dataType.simpleString() for f in frame.schema}
            duck_types = dict(zip(want.columns, map(str, want.types)))
            reason = difference(got, want.df())
            kinds = {n: (t, duck_types.get(n)) for n, t in types.items() if _kind(t) != _kind(str(duck_types.get(n)))}
            print(f"{'FAIL ' if reason else 'ok   '} {name} {len(got)} rows {took:.1f}s duck {time.time() - start:.1f}s {reason or ''} {kinds or ''}", flush=True)
            failures += bool(reason)
        except Exception as error:  # report and go on with the next query
            failures += 1
            print(f"ERROR {name} {type(error).__name__}: {str(error)[:600]}", flush=True)
    print("failures:", failures)
    return failures


def _kind(name: str) -> str:
    name = name.lower()
    return {"varchar": "string", "integer": "int", "hugeint": "bigint!"}.get(name, name)


if __name__ == "__main__":
    sys.exit(main())
