"""Every query of the library against its SQL on the small tables."""

import os

import duckdb
import pytest

from quillspan.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(x):
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return float(x) if type(x).__name__ == "Decimal" else x


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    order = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    if name not in ORACLES:
        assert rows
        return
    found = db.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == order
    want = [tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
