"""Compare queries with their DuckDB twins: ``python tests/oracle_check.py SF [name …]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pd.api.types.is_float_dtype(pdf[c]):
            pdf[c] = pdf[c].map(lambda v: None if pd.isna(v) else f"{v:.9g}")
        elif pd.api.types.is_datetime64_any_dtype(pdf[c]):
            pdf[c] = pdf[c].map(lambda v: None if pd.isna(v) else str(pd.Timestamp(v).as_unit("us")))
        else:
            pdf[c] = pdf[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
    pdf = pdf.astype(object).where(pdf.notna(), "∅")
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


DUCK_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
              "timestamp_ntz": "TIMESTAMP"}


def compare(spark, con, folder: str, name: str) -> str:
    """'' if both sides agree in columns, types and values, else what differs."""
    df = entry_module.queries()[name](spark, folder)
    sql = entry_module.oracle_sql()[name]
    types = {c: DUCK_TYPES.get(t, t) for c, t in df.dtypes}
    duck = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if types != duck:
        return f"types differ: {sorted(set(types.items()) ^ set(duck.items()))}"
    got = canonical(df.toPandas())
    want = canonical(con.execute(sql).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} != {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    diff = (got != want).any(axis=1)
    if diff.any():
        i = diff.idxmax()
        return f"{diff.sum()} rows differ, first:\n  spark  {got.loc[i].to_dict()}\n  duckdb {want.loc[i].to_dict()}"
    return ""


if __name__ == "__main__":
    from emberlog.session import local_session

    spark = local_session()
    folder = f"/root/testdata/sf{sys.argv[1]}"
    con = connect(folder)
    bad = 0
    for name in sys.argv[2:] or entry_module.queries():
        t = time.time()
        try:
            if name in entry_module.oracle_sql():
                result = compare(spark, con, folder, name)
            else:
                result = f"rows only: {entry_module.queries()[name](spark, folder).count()}"
        except Exception as e:
            result = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(result)
        print(f"{name:28s} {time.time() - t:6.2f}s  {result or 'ok'}", flush=True)
    print("not ok:", bad)
