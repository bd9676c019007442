"""Runs a query's SQL in DuckDB over the same tables and compares."""

import glob
import os

import duckdb


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]

    def value(v):
        if v is None or v != v:
            return None
        return round(float(v), 9) if isinstance(v, float) else str(v) if not isinstance(v, int | bool) else int(v)

    return sorted((tuple(value(v.item() if hasattr(v, "item") else v) for v in r) for r in pdf.itertuples(index=False)), key=repr)


def same(spark, data, query, sql):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    mine, theirs = query(spark, data).toPandas(), con.execute(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert len(mine) == len(theirs)
    ints = [c for c in mine.columns if str(theirs[c].dtype) in ("Int64", "int64", "int32") and mine[c].notna().all()]
    mine[ints], theirs[ints] = mine[ints].astype("int64"), theirs[ints].astype("int64")
    for c in set(mine.columns) - set(ints):
        if mine[c].dtype == float or str(theirs[c].dtype) == "Int64":
            mine[c], theirs[c] = mine[c].astype(float), theirs[c].astype(float)
    assert rows_of(mine) == rows_of(theirs)
