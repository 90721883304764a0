from pathlib import Path

import duckdb
import pytest

from medialedger.plans import details, operations, readers, registry  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
ALL, SQL = registry.QUERIES, registry.ORACLES


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, db, name):
    rows = ALL[name](spark, FOLDER)
    columns = sorted(rows.columns)
    want = db.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in rows.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
