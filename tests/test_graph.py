import collections
import random

import pytest
from pyspark.sql import functions as F

from sievewell.operators import graph
from sievewell.queries import surface


def test_merge_and_edges(spark):
    e = spark.createDataFrame([("Acme  Corp", "org", "short", 1, 1), ("acme corp ", "x", "a longer one", 2, 2), ("ACME CORP", "y", "another long", 1, 3), ("Bob", "person", "", 3, 4)], "name string, type string, description string, chunk_id bigint, ord int")
    m = {r.key: r for r in graph.merge_entities(e, "ord").collect()}
    assert m["acme corp"].name == "Acme  Corp" and m["acme corp"].type == "org" and m["acme corp"].description == "a longer one" and m["acme corp"].chunk_ids == [1, 2]
    edges = spark.createDataFrame([("ACME corp", "bob", "d"), ("bob", "nobody", "d")], "source string, target string, description string")
    assert [(r.s, r.t) for r in graph.valid_edges(edges, graph.merge_entities(e, "ord")).collect()] == [("acme corp", "bob")]


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(x,) for x in parent], "id int")
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(pairs, "a int, b int"), nodes).collect()}
    assert got == {x: find(x) for x in parent}


def test_communities(spark):
    clique = lambda xs: [(a, b) for a in xs for b in xs if a < b]
    edges = [*clique(range(5)), *clique(range(10, 14)), (4, 10)]
    assert graph.greedy_modularity(edges) == [[0, 1, 2, 3, 4], [10, 11, 12, 13]]
    assert graph.greedy_modularity([]) == [] and graph.greedy_modularity([("a", "b"), ("c", "d")]) == [["a", "b"], ["c", "d"]]
    df = spark.createDataFrame(edges, "a int, b int")
    got = graph.communities(df).groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("x")).orderBy("community").collect()
    assert [r.x for r in got] == [[0, 1, 2, 3, 4], [10, 11, 12, 13]]
    labels = {r.id: r.community for r in graph.label_propagation(df).collect()}
    assert len({labels[i] for i in range(5)}) == 1 and len({labels[i] for i in range(10, 14)}) == 1


def test_size_does_not_choose_the_method(spark, monkeypatch):
    path = spark.createDataFrame([(i, i + 1) for i in range(12)], "a int, b int")
    small = {r.id: r.community for r in graph.communities(path).collect()}
    monkeypatch.setattr(graph, "DRIVER_EDGES", 12)
    assert {r.id: r.community for r in graph.communities(path).collect()} == small
    monkeypatch.setattr(graph, "DRIVER_EDGES", 11)
    with pytest.raises(ValueError, match="labels"):
        graph.communities(path)
    assert graph.communities(path, "labels").count() == len(small)
    with pytest.warns(UserWarning, match="converge"):
        graph.label_propagation(path, 1)


def test_communities_ranked_and_rebuilt(spark):
    c = spark.createDataFrame([(0, "s", ["a", "b"], ["x"], [1.0, 0.0]), (1, "s", ["a"], ["y"], [0.0, 1.0]), (2, None, ["a", "b", "c"], [], None)], "id int, summary string, entity_names array<string>, sources array<string>, embedding array<double>")
    assert [r.id for r in graph.rank_communities(c, [0.1, 1.0]).collect()] == [1, 0]
    assert [r.id for r in graph.rank_communities(c, [0.1, 1.0], live=["x"]).collect()] == [0]
    assert [r.id for r in graph.select_by_size(c).collect()] == [0] and [r.id for r in graph.select_by_size(c.filter("id = 1")).collect()] == [1]
    live = spark.createDataFrame([("x",)], "source string")
    assert sorted(r.id for r in graph.rebuild(c, live).collect()) == [0, 2]
    assert [r.source for r in graph.stale_sources(c, live).collect()] == ["y"]


def test_joins_of_rounds_are_not_broadcast(spark, monkeypatch):
    """The tables are small enough for adaptive execution to broadcast them, which it would also do with compressed large ones."""
    kind, plans = type(spark.range(1)), []
    run = kind.checkpoint

    def checkpoint(self, *args):
        out = run(self, *args)
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(kind, "checkpoint", checkpoint)
    edges = spark.range(40).selectExpr("id AS a", "id - id % 5 AS b")
    assert {(r.id, r.community) for r in graph.label_propagation(edges).collect()} == {(i, i - i % 5) for i in range(40)}
    assert {(r.id, r.component) for r in graph.components(edges).collect()} == {(i, i - i % 5) for i in range(40)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_recursion_beyond_the_row_limit(spark, tmp_path):
    spark.createDataFrame([(i,) for i in [*range(1, 30), 9, 18]], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    want = collections.Counter(map(tuple, surface.run(spark, str(tmp_path), surface.R.sql["sql_recursive"]).collect()))
    assert want[9, 1, 2] == 2 and want[27, 1, 3] == 2
    limit = "spark.sql.cteRecursionRowLimit"
    was = spark.conf.get(limit)
    spark.conf.set(limit, "20")
    try:
        assert collections.Counter(map(tuple, surface.R.queries["sql_recursive"](spark, str(tmp_path)).collect())) == want
    finally:
        spark.conf.set(limit, was)


def test_modularity_by_component_is_that_of_the_whole(spark, monkeypatch):
    """The components together have more edges than one may have."""
    rnd = random.Random(5)
    pairs = [(100 * c + rnd.randrange(30 - c), 100 * c + rnd.randrange(30 - c)) for c in range(6) for _ in range(45)] + [(3, 3), (901, 900), (900, 901)]
    want = [(i, x) for i, c in enumerate(graph.greedy_modularity(pairs)) for x in c]
    monkeypatch.setattr(graph, "DRIVER_EDGES", 50)
    df = spark.createDataFrame([("%04d" % a, "%04d" % b) for a, b in pairs], "a string, b string")
    assert sorted(map(tuple, graph.communities(df).collect())) == sorted((i, "%04d" % x) for i, x in want)
