from pathlib import Path

import duckdb
import pytest

from medialedger.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    rows = queries.QUERIES[name](spark, FOLDER)
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(rows.columns)
    assert sorted(repr(tuple(r[c] for c in names)) for r in rows.collect()) == sorted(map(repr, want.fetchall()))
