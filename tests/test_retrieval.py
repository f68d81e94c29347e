import math
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sievewell.operators import metrics, retrieval
from sievewell.plans import rerankers
from sievewell.queries import retrieval as queries


def test_vector_batch_is_exact(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, embedding array<double>").repartition(5)
    q = df.filter("id < 3").withColumnRenamed("id", "qid")
    got = retrieval.vector_top_k_batch(df, q, 7).collect()
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(3):
        assert [r.id for r in sorted((r for r in got if r.qid == i), key=lambda r: r["rank"])] == np.argsort(-(n @ n[i]), kind="stable")[:7].tolist()
    one = retrieval.vector_top_k(df, v[0].tolist(), 7).collect()
    assert [r.id for r in one] == [r.id for r in sorted((r for r in got if r.qid == 0), key=lambda r: r["rank"])]


def test_fusion(spark):
    leg = lambda ids: spark.createDataFrame([(1, x, i) for i, x in enumerate(ids, 1)], "qid int, id int, rank int")
    got = retrieval.fuse([leg([1, 2]), leg([3, 1])], 3).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3, 2] or [r.id for r in got] == [1, 2, 3]
    assert math.isclose(got[0].score, 1 / 61 + 1 / 62, abs_tol=1e-9)
    assert retrieval.fuse([leg([]), leg([])], 3).count() == 0


def test_rerank(spark):
    df = spark.createDataFrame([(1, i, 0.0, i, "q", "x" * i) for i in range(1, 15)], "qid int, id int, score double, rank int, query string, content string")
    best = retrieval.rerank(df, lambda q, c: [len(x) for x in c], 3).orderBy("rank").collect()
    assert [r.id for r in best] == [14, 13, 12]
    assert retrieval.rerank(df, None, 2).count() == 2
    listed = rerankers.by_list(df, lambda: lambda messages: "3, 99, 1", 20).orderBy("rank").collect()
    assert [r.id for r in listed][:3] == [3, 1, 2] and len(listed) == 12
    assert [r.id for r in rerankers.by_list(df, lambda: lambda messages: "no idea", 2).orderBy("rank").collect()] == [1, 2]
    assert retrieval.relevance_floor(df, 0.5, False).count() == 14 and retrieval.relevance_floor(df, 0.5, True).count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "a", "c"], ["a", "c"]), (["x"], ["a"]), (["x"], [])], "retrieved array<string>, relevant array<string>")
    got = [(r.recall, r.mrr, r.hit) for r in metrics.per_query(df, 4).collect()]
    assert got == [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
    assert metrics.per_query(df, 0).agg(F.sum("recall")).first()[0] == 0
    s = metrics.summary(metrics.per_query(df, 4)).first()
    assert (s.n, s.recall, s.mrr) == (2, 0.5, 0.5)
    p = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40, 50)], "x double")
    assert p.select(metrics.percentile("x", 0.95)).first()[0] == 48.0 and p.limit(0).select(metrics.percentile("x", 0.5)).first()[0] == 0.0


def test_result_match(spark):
    assert metrics.rows_match([(1, "a"), (2.00001, None)], [(2, None), (1, "a")]) and not metrics.rows_match([(1,)], [(2,)]) and not metrics.rows_match([(1,)], [])
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "n int, s string")
    assert metrics.same_rows(a, a.orderBy(F.desc("n"))) and not metrics.same_rows(a, a.distinct())


def test_nearest_in_bounded_memory():
    rnd = np.random.default_rng(5)
    v, q = rnd.integers(-2, 3, (2000, 6)).astype(float), rnd.integers(-2, 3, (4096, 6)).astype(float)
    v[7] = 0
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    ids = [f"d{(i * 7) % 2000}" for i in range(2000)]
    schema = pa.schema([("qid", pa.int64()), ("id", pa.string()), ("score", pa.float64())])
    batches = [pa.record_batch([pa.array(ids[i : i + 1000]), pa.array(list(v[i : i + 1000]))], ["id", "v"]) for i in (0, 1000)]
    tracemalloc.start()
    found = [x for b in retrieval.nearest(iter(batches), list(range(4096)), unit(q), 10, 6, schema) for x in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = {}
    for x in found:
        got.setdefault(x["qid"], []).append((-x["score"], x["id"]))
    scores = np.round(unit(q)[:50] @ unit(v).T, 6) + 0.0
    assert len(got) == 4096 and all(sorted(got[i]) == sorted(zip((-scores[i]).tolist(), ids, strict=True))[:10] for i in range(50))
    assert peak < 60e6, peak  # all scores of a batch at once take 32 MB, and were copied three times


def test_config_compare_searches_once(spark):
    shown = queries.config_compare(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("MapInArrow") == 1
