"""Row-by-row comparison of a Spark result with DuckDB's."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def norm(x):
    return float(f"{x:.9g}") if isinstance(x, float) else x


def compare(df, sql, sf_dir):
    rel = connect(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    names = sorted(df.columns)
    ours = Counter(tuple(norm(r[c]) for c in names) for r in df.toLocalIterator())
    at = [rel.columns.index(c) for c in names]
    theirs = Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
    return sum(ours.values())
