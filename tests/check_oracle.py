"""Compare registered queries with their SQL: python tests/check_oracle.py [sf] [names]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return v.item() if hasattr(v, "item") else v

    rows = [tuple(cell(v) for v in r) for r in df.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), v) if v is not None
                                            else (True, "", 0) for v in r))


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} vs {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}


def type_differences(df, relation) -> str | None:
    """Columns whose Spark type and SQL type are not the same."""
    sql = dict(zip(relation.columns, map(str, relation.types)))
    bad = [f"{c} {k} vs {sql.get(c)}" for c, k in df.dtypes if SAME_TYPE.get(k) != sql.get(c)]
    return f"types {bad}" if bad else None


def main() -> int:
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = make_session(), connect(sf)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            got = df.toPandas()
            took = time.time() - start
            want = con.sql(entry.oracle_sql()[name])
            problem = type_differences(df, want) or differences(got, want.df())
            print(f"{'ok  ' if not problem else 'FAIL'} {name} {len(got)} rows {took:.1f}s "
                  f"{problem or ''}", flush=True)
        except Exception as e:  # report and go on with the next query
            problem = str(e)
            print(f"FAIL {name} {type(e).__name__} {problem[:600]}", flush=True)
        failed += bool(problem)
    print(f"{len(names) - failed} of {len(names)} match")
    return failed


if __name__ == "__main__":
    sys.exit(main())
