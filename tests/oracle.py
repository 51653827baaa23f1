"""Spark rows against the rows that DuckDB gives for the same tables."""

import datetime
import decimal
import glob
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = sorted(glob.glob(f"{path}/*.parquet")) if os.path.isdir(path) else [path]
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files})")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return None if x != x else round(x, 9) + 0.0
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def differences(spark, sf_dir, query, sql):
    """None if equal, else what differs first."""
    df = query(spark, sf_dir)
    con = duck(sf_dir)
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    want = rows_of(columns, rel.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return None
    only = [x for x in got if x not in want][:2] if len(got) < 5000 else [a for a, b in zip(got, want) if a != b][:2]
    other = [x for x in want if x not in got][:2] if len(got) < 5000 else [b for a, b in zip(got, want) if a != b][:2]
    return f"{len(got)} rows and {len(want)}; {sorted(columns)}; {only} and {other}"
