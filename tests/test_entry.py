import duckdb
import pytest

import __spark_entry__
from veridex.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def test_flagship_query(spark):
    assert __spark_entry__.entry(spark).count() > 0


def rows(values, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(v):
        return round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else str(v) if isinstance(v, list) else v

    return sorted((tuple(plain(row[i]) for i in order) for row in values), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows(frame.collect(), frame.columns) == rows(found.fetchall(), columns)
