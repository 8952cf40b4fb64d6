"""Runs SQL in DuckDB over the given tables and compares it with a DataFrame."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


def expected(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), in_order(plain([row[i] for i in order]) for row in result.fetchall())


def found(df):
    names = sorted(df.columns)
    return names, in_order(plain(tuple(row)) for row in df.select(*[f"`{c}`" for c in names]).collect())
