import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievewell.plans import report
from sievewell.sources import star as module
from sievewell.sources.star import Dimension, Fact, KeyCollision, Star

USER = Dimension("dim_user", "user", "city string")
VISITS = Fact("visits", "id", "at", {"user": USER}, "version")
SCHEMA = "id int, at timestamp, user string, version int, n int"


def at(day):
    return dt.datetime(2024, 1, day, 12)


def facts(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def seen(star):
    return sorted((r.id, str(r.day), r.user, r.city, r.n) for r in star.joined(VISITS).collect())


def test_loads(spark, tmp_path):
    star = Star(spark, str(tmp_path))
    first = facts(spark, (1, at(1), "a", 1, 10), (2, at(1), "b", 1, 20), (3, at(2), None, 1, 30), (1, at(1), "a", 1, 10))
    assert star.load_fact(VISITS, first) == 2
    want = [(1, "2024-01-01", "a", None, 10), (2, "2024-01-01", "b", None, 20), (3, "2024-01-02", None, None, 30)]
    assert seen(star) == want
    keys = {r.user: r.dim_user_sk for r in star.dimension(USER).collect()}
    assert keys[None] == 0 and all(r.inferred for r in star.dimension(USER).filter("user is not null").collect())
    star.load_fact(VISITS, first)
    assert seen(star) == want
    star.load_dimension(USER, spark.createDataFrame([("b", "Bonn"), ("c", "Cork"), ("b", "Bern"), (None, "none")], "user string, city string"))
    assert {r.user: r.dim_user_sk for r in star.dimension(USER).collect()}.items() > keys.items()  # the same keys, and one more
    assert {(r.user, r.city, r.inferred) for r in star.dimension(USER).collect()} == {(None, None, False), ("a", None, True), ("b", "Bonn", False), ("c", "Cork", False)}
    # a newer version on another day takes the old one's place, and empties its day; an older one changes nothing
    assert star.load_fact(VISITS, facts(spark, (3, at(5), "c", 2, 31), (2, at(1), "b", 0, 99))) == 2
    assert seen(star) == [(1, "2024-01-01", "a", None, 10), (2, "2024-01-01", "b", "Bonn", 20), (3, "2024-01-05", "c", "Cork", 31)]
    star.load_fact(VISITS, facts(spark))
    assert len(seen(star)) == 3


def test_only_touched_days_are_rewritten(spark, tmp_path):
    star = Star(spark, str(tmp_path))
    star.load_fact(VISITS, facts(spark, (1, at(1), "a", 1, 10), (2, at(2), "a", 1, 20)))
    files = {p.name for p in (tmp_path / "visits" / "day=2024-01-01").glob("*.parquet")}
    star.load_fact(VISITS, facts(spark, (3, at(2), "a", 1, 30)))
    assert {p.name for p in (tmp_path / "visits" / "day=2024-01-01").glob("*.parquet")} == files
    assert not list((tmp_path / "_staged").iterdir())


def test_refused(spark, tmp_path, monkeypatch):
    star = Star(spark, str(tmp_path))
    with pytest.raises(ValueError, match="without id"):
        star.load_fact(VISITS, facts(spark, (None, at(1), "a", 1, 10)))
    monkeypatch.setattr(module.Dimension, "sk", lambda self, c: F.when(c.isNull(), F.lit(0).cast("bigint")).otherwise(F.lit(7).cast("bigint")))
    with pytest.raises(KeyCollision):
        star.load_fact(VISITS, facts(spark, (1, at(1), "a", 1, 10), (2, at(1), "b", 1, 10)))


def test_rules(spark, tmp_path):
    star = Star(spark, str(tmp_path))
    star.load_fact(VISITS, facts(spark, (1, at(1), "a", 1, 10), (2, at(1), "b", 1, 10), (3, at(1), "b", 1, None)))
    assert star.broken(VISITS, report.broken_rules).count() == 0
    parent = spark.createDataFrame([("a",), (None,)], "name string")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "id int, x string")
    assert [tuple(r) for r in report.broken_rules(rows, "id", relationships={"x": (parent, "name")}).collect()] == [("relationships:x", 2)]


def test_trend(spark):
    runs = spark.createDataFrame([("c", "m", "1", 1.0), ("c", "m", "1", 3.0), ("c", "m", "2", 5.0), ("c", "m", "3", None), ("d", "m", "1", 1.0)], "config string, metric string, day string, value double")
    got = [tuple(r) for r in report.eval_trend(runs).orderBy("config", "day").collect()]
    assert got == [("c", "m", "1", 2, 2.0, None), ("c", "m", "2", 1, 5.0, 3.0), ("c", "m", "3", 0, None, None), ("d", "m", "1", 1, 1.0, None)]
