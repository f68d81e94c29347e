"""Every registered query of the engine against its SQL, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from sievewell import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 4) + 0.0
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def same(spark, duck, query, sql):
    df = query(spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(repr([norm(v) for v in r]) for r in df.select(*cols).collect())
    c = duck.execute(sql)
    names = [x[0] for x in c.description]
    assert sorted(names) == cols
    at = [names.index(x) for x in cols]
    assert got == sorted(repr([norm(r[i]) for i in at]) for r in c.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    same(spark, duck, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
