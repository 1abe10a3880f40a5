"""Results of two engines as comparable lists of rows."""

from pathlib import Path

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(folder, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def same(df, con, sql):
    got = canon([tuple(r) for r in df.collect()], df.columns)
    cur = con.execute(sql)
    want = canon(cur.fetchall(), [c[0] for c in cur.description])
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert repr(a) == repr(b), (a, b)
