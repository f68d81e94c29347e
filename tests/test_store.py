import pytest

from sievewell.sources.store import KEEP, Conflict, Versioned


def table(spark, path):
    return Versioned(spark, str(path), "x int")


def numbers(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "x int")


def values(df):
    return sorted(r.x for r in df.collect())


def test_readers_survive_replacements(spark, tmp_path):
    t = table(spark, tmp_path)
    assert not t.exists() and t.read().count() == 0
    t.replace(numbers(spark, 1))
    begun = t.read()
    for i in (2, 3):
        t.replace(numbers(spark, i))
    assert values(begun) == [1] and values(t.read()) == values(table(spark, tmp_path).read()) == [3]
    t.replace(t.read().unionByName(numbers(spark, 4)))  # from what it holds itself
    assert values(t.read()) == [3, 4]
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("v-")]) == KEEP


def test_of_two_writers_one_fails(spark, tmp_path):
    a, b = table(spark, tmp_path), table(spark, tmp_path)
    a.read(), b.read()
    a.replace(numbers(spark, 1))
    with pytest.raises(Conflict):
        b.replace(numbers(spark, 2))
    assert values(b.read()) == [1] and len([p for p in tmp_path.iterdir() if p.name.startswith("v-")]) == 1
    b.replace(numbers(spark, 2))  # it has read the other's version now
    assert values(a.read()) == [2]
    with pytest.raises(Exception, match="."):
        a.replace(numbers(spark, 1).selectExpr("x / 0 AS x"))
    assert values(a.read()) == [2]
