"""Every query that has SQL gives the rows that DuckDB gives; the others run."""

import duckdb
import pytest

from sigloom import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 5) + 0.0)
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    found = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    if name in registry.SQL:
        names = ", ".join(f'"{c}"' for c in columns)
        want = sorted(tuple(map(plain, r)) for r in duck.execute(f"select {names} from ({registry.SQL[name]}) q").fetchall())
        assert found == want
