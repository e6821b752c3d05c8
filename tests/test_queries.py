"""Every registered query with SQL gives what the SQL gives, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quillmask import catalog
from verify import digest

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(D).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    return [plain(x) for x in v] if isinstance(v, list) else v


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLE_SQL])
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, D)
    out = db.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, [list(r) for r in df.collect()]) == digest(columns, [plain(list(r)) for r in out.fetchall()])


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_query_runs(spark, name):
    assert len(catalog.QUERIES[name](spark, D).collect()) > 0
