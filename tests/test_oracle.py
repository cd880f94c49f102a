"""Every query beside its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from usagelens.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    if name in ORACLE:
        db = duckdb.connect()
        for f in os.listdir(FOLDER):
            db.execute(f"create view {f.split('.')[0]} as select * from '{FOLDER}/{f}'")
        got = db.execute(ORACLE[name])
        columns = [d[0] for d in got.description]
        assert sorted(columns) == sorted(df.columns)
        want = [tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in got.fetchall()]
        assert sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=repr) == sorted(want, key=repr)
