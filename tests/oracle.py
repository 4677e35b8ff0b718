"""Holds registered queries against their SQL."""

from collections import Counter
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    """Rows as a multiset, with columns by name and floats to nine digits."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: float(f"{x:.9g}") if isinstance(x, float) else x
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in values)


def agree(spark, query, sql):
    df = query(spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    found = con.execute(sql)
    assert got == rows([d[0] for d in found.description], found.fetchall())
