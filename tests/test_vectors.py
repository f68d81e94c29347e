import numpy as np
import pytest

from sievewell.operators import retrieval
from sievewell.sources import store, vectors


def frame(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in rows], "id bigint, embedding array<double>").repartition(3)


def same(index, df, q, k):
    got, used = index.search(q, k, 6)
    a = sorted((r.qid, r.rank, r.id, r.score) for r in got.collect())
    b = sorted((r.qid, r.rank, r.id, r.score) for r in retrieval.vector_top_k_batch(df, q, k, digits=6).collect())
    assert a == b and len(a) > 0
    return used


def test_equals_the_scan(spark, tmp_path, monkeypatch):
    """Tight groups, repeated vectors, zeros, one group with a third of all rows; blocks of questions; more vectors later."""
    monkeypatch.setattr(vectors, "QUESTION_BLOCK", 7)
    rnd = np.random.default_rng(3)
    heads = rnd.normal(size=(12, 16))
    rows = [(i, heads[0 if i % 3 == 0 else i % 12] + 0.05 * rnd.normal(size=16)) for i in range(900)]
    rows += [(900 + i, rows[0][1]) for i in range(30)] + [(930 + i, np.zeros(16)) for i in range(5)]
    first, later = frame(spark, rows[:600]), frame(spark, rows[600:])
    index = vectors.VectorIndex(spark, f"{tmp_path}/index")
    index.build(first, clusters=12)
    q = frame(spark, [(i, rows[i][1]) for i in range(0, 900, 60)] + [(5000, np.zeros(16)), (5001, rnd.normal(size=16))]).withColumnRenamed("id", "qid")
    same(index, first, q, 5)
    index.add(later)
    both = first.unionByName(later)
    same(index, both, q, 5)
    used = same(index, both, q.filter("qid < 900 and qid % 3 <> 0 or qid = 0"), 5)
    assert used["scored"] < 0.6
    same(index, both, q, 900)  # more than any cluster holds


def test_spread_vectors(spark, tmp_path):
    """Without any structure nothing can be skipped, and nothing is lost."""
    rnd = np.random.default_rng(4)
    df = frame(spark, enumerate(rnd.normal(size=(300, 4))))
    index = vectors.VectorIndex(spark, f"{tmp_path}/index")
    index.build(df)
    same(index, df, df.filter("id < 20").withColumnRenamed("id", "qid"), 7)


def test_edges(spark, tmp_path):
    index = vectors.VectorIndex(spark, f"{tmp_path}/index")
    with pytest.raises(ValueError, match="nothing is built"):
        index.add(frame(spark, [(1, [1.0, 0.0])]))
    good = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    index.build(frame(spark, [*good, (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0])]))
    q = frame(spark, [(9, [1.0, 1.0])]).withColumnRenamed("id", "qid")
    assert same(index, frame(spark, good), q, 10)["read"] == 1.0
    assert index.top_k(q.limit(0), 3).count() == 0
    empty = vectors.VectorIndex(spark, f"{tmp_path}/empty")
    empty.build(frame(spark, []))
    assert empty.top_k(q, 3).count() == 0
    empty.add(frame(spark, [(0, [0.0, 0.0]), *good]))  # there are no centres
    same(empty, frame(spark, [(0, [0.0, 0.0]), *good]), q, 2)


def test_two_writers(spark, tmp_path):
    a, b = (vectors.VectorIndex(spark, f"{tmp_path}/index") for _ in range(2))
    a.build(frame(spark, [(1, [1.0, 0.0])]))
    old = b.segments.read()
    a.add(frame(spark, [(2, [0.0, 1.0])]))
    with pytest.raises(store.Conflict):
        b.segments.replace(old)
    q = frame(spark, [(9, [1.0, 1.0])]).withColumnRenamed("id", "qid")
    assert a.top_k(q, 5).count() == 2
