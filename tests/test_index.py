import random

import pytest
from pyspark.sql import functions as F

from sievewell.operators import retrieval
from sievewell.queries import retrieval as queries
from sievewell.sources import index as module
from sievewell.sources.index import Conflict, KeywordIndex

FOLDER = "/root/testdata/sf0.001"


def texts(spark, seed, sources, ids):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    return spark.createDataFrame([(i, rnd.choice(sources), " ".join(rnd.choices(words, [1 / (j + 1) for j in range(30)], k=rnd.randrange(0, 40)))) for i in ids], "id bigint, source string, content string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "PROBE", 2)
    index = KeywordIndex(spark, str(tmp_path), 8, 16)
    questions = spark.createDataFrame([(1, "w0 W3"), (2, "w29"), (3, "w28 w27 w26"), (4, "nothing"), (5, ""), (6, None)], "qid int, query string")
    assert index.top_k(questions, 5).count() == 0
    a, b, c = texts(spark, 1, ["a", "b", None], range(200)), texts(spark, 2, ["b"], range(1000, 1050)), texts(spark, 3, ["c"], range(2000, 2020))
    same = lambda live: [rows(index.top_k(questions, k)) for k in (1, 5, 300)] == [rows(retrieval.keyword_top_k(live, questions, k)) for k in (1, 5, 300)]
    index.update(a)
    assert same(a)
    before = index.commits()
    index.update(b.unionByName(c))  # takes the place of all of b
    live = a.filter("source is null or source <> 'b'").unionByName(b).unionByName(c)
    assert same(live)
    index.delete("c")
    live = live.filter("source is null or source <> 'c'")
    assert same(live)
    index.compact()
    assert len(index.commits()) == 1 and same(live)
    index.update(texts(spark, 4, ["a"], range(200)).filter("id < 50"))
    assert same(live.filter("source is null or source <> 'a'").unionByName(texts(spark, 4, ["a"], range(200)).filter("id < 50")))
    monkeypatch.setattr(KeywordIndex, "commits", lambda self: before)  # a reader that has begun keeps what it saw
    assert same(a)
    with pytest.raises(Conflict):  # and so would a writer
        index.update(c)


def test_reads_less(spark, tmp_path):
    index = queries.stored_index(spark, FOLDER)
    questions = queries.asked(spark, FOLDER).withColumn("query", F.element_at(F.split("query", " "), -1))
    assert rows(index.top_k(questions, 3)) == rows(retrieval.keyword_top_k(queries.corpus(spark, FOLDER)[1], questions, 3))
    plan = index.plan(questions, 3)
    assert 0 < plan.filter("read").count() < plan.count()
    entries, _ = index._entries(questions.limit(1), index.commits())
    shown = entries._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in shown or "bucket#" in shown.split("PartitionFilters:")[1][:60]


def test_blocks_follow_documents(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path), 4, 2)
    docs = spark.range(20000).selectExpr("id", "'a' AS source", "concat('x y', id % 50, repeat(' z', cast(id % 7 AS int))) AS content")
    index.update(docs)
    entries = index._table("postings", index.postings_schema, index.commits())
    assert entries.filter("term = 'x'").count() == 20000 // module.BLOCK_DOCS  # not 2, whose size grows with the table
    assert entries.filter("term = 'x'").agg(F.sum(F.size("found"))).first()[0] == 20000
    questions = spark.createDataFrame([(1, "x z"), (2, "y7 z"), (3, "y49")], "qid int, query string")
    assert rows(index.top_k(questions, 20)) == rows(retrieval.keyword_top_k(docs, questions, 20))


def test_id_in_two_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "PROBE", 1)
    index = KeywordIndex(spark, str(tmp_path), 4, 4)
    a = spark.createDataFrame([(i, "a", "x " * (6 if i == 1 else 4)) for i in range(1, 3)], "id bigint, source string, content string")
    b = spark.createDataFrame([(2, "b", "x x x x")], "id bigint, source string, content string")
    index.update(a)
    index.update(b)
    questions = spark.createDataFrame([(1, "x")], "qid int, query string")
    assert rows(index.top_k(questions, 1)) == rows(retrieval.keyword_top_k(a.unionByName(b), questions, 1)) == [(1, 2, 0.8, 1)]
