"""Compare a registered query with its SQL on one data folder."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return str(x) if x is not None and not isinstance(x, (int, str, bool)) else x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in values), key=repr)


def difference(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    rel = con.execute(sql)
    names = [c[0] for c in rel.description]
    want = rows(names, rel.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        odd = next(((a, b) for a, b in zip(got, want) if a != b), None)
        return f"{len(got)} and {len(want)} rows; first difference {odd}"
    return None
