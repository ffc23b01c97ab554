"""Runs a query and its SQL on the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 7) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=lambda r: tuple((v is None, str(v)) for v in r))


def by_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{sf_dir}/{t}.parquet'")
    r = con.sql(sql)
    return sorted(r.columns), rows(r.columns, r.fetchall())


def by_spark(df):
    return sorted(df.columns), rows(df.columns, df.collect())
