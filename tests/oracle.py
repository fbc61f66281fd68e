"""Runs a query and its SQL on the same tables and compares the rows as sorted text."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def sql(text: str, sf: str = SF):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c.sql(text).df()


def rows(df) -> list[tuple]:
    def one(x):
        if x is None or str(x) in ("<NA>", "NaT", "nan"):
            return "NULL"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        try:
            return f"{float(x):.6f}" if not isinstance(x, str) else x
        except (TypeError, ValueError):
            return str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(one(x) for x in r) for r in df.itertuples(index=False)), key=str)


def same(spark, f, text: str, sf: str = SF) -> None:
    got, want = f(spark, sf).toPandas(), sql(text, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
