"""Retrieval and evaluation. The fixtures have no link from vectors to documents; ``vec_id = doc_id = item_id`` is our convention."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from ..config import Settings
from ..operators import metrics, retrieval
from ..operators.graph import ensure_checkpoint_dir
from ..plans import rerankers
from ..sources.index import KeywordIndex
from ..sources.vectors import VectorIndex
from . import Registry, load

R = Registry()

#: Questions: every 20th benchmark item, with the vector of that number.
_ASKED = "SELECT item_id AS qid, text AS query FROM benchmark WHERE item_id % 20 = 0"
_COS = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6)"
_VEC = f"""vec AS (SELECT * FROM (SELECT q.qid, b.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY q.qid ORDER BY {_COS} DESC, b.vec_id) AS rank
  FROM ({_ASKED}) q JOIN embeddings a ON a.vec_id = q.qid CROSS JOIN embeddings b) WHERE rank <= 20)"""
_KEY = rf"""terms AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS term FROM ({_ASKED})),
toks AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM documents),
scored AS (SELECT qid, doc_id AS id, round(count(*) * CAST(0.1 AS DOUBLE), 6) AS score FROM toks JOIN terms USING (term) GROUP BY qid, doc_id),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 20)"""
_RRF = f"""WITH {_VEC}, {_KEY},
legs AS (SELECT qid, id, rank, 0 AS leg FROM vec UNION ALL SELECT qid, id, rank, 1 FROM kw),
fused AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 9) AS score, min(leg * 1000 + rank) AS first FROM legs GROUP BY qid, id),
best AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first, id) AS rank FROM fused)"""


def asked(spark, d):
    q = load(spark, d, "benchmark").filter("item_id % 20 = 0").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    e = load(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    return q.join(e, "qid")


def corpus(spark, d):
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), load(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")


@R.add("keyword_topk", f"WITH {_KEY} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM kw")
def keyword_topk(spark, d):
    return retrieval.keyword_top_k(corpus(spark, d)[1], asked(spark, d), 20)


def stored_index(spark, d):
    """An index of all documents, some sources of which were stored otherwise before, deleted and stored again."""
    docs = corpus(spark, d)[1]
    ensure_checkpoint_dir(docs)
    index = KeywordIndex(spark, f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}")
    odd = F.col("source").isin("src1", "src12")
    index.update(docs.withColumn("content", F.when(odd, F.concat("content", F.lit(" the "), "content")).otherwise(F.col("content"))))
    index.update(docs.filter("source = 'src1'"))
    index.delete("src12")
    index.update(docs.filter("source = 'src12'"))
    return index


@R.add("keyword_index_topk", f"WITH {_KEY} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM kw")
def keyword_index_topk(spark, d):
    return stored_index(spark, d).top_k(asked(spark, d), 20)


@R.add("vector_topk", f"SELECT b.vec_id AS id, {_COS} AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id = 0 ORDER BY {_COS} DESC, id LIMIT 20")
def vector_topk(spark, d):
    v = load(spark, d, "embeddings")
    q = v.filter("vec_id = 0").first().embedding
    return retrieval.vector_top_k(v, q, 20, "vec_id").select("id", F.round("score", 6).alias("score"))


_NEAREST = f"SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT a.vec_id AS qid, b.vec_id AS id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 10"


@R.add("vector_topk_batch", _NEAREST)
def vector_topk_batch(spark, d):
    v = load(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return retrieval.vector_top_k_batch(v, v.filter("id % 20 = 0").withColumnRenamed("id", "qid"), 10, digits=6)


@R.add("vector_index_topk", _NEAREST)
def vector_index_topk(spark, d):
    """From a stored index of all vectors, two thirds of them added after it was built."""
    v = load(spark, d, "embeddings").withColumnRenamed("vec_id", "id").select("id", "embedding")
    ensure_checkpoint_dir(v)
    index = VectorIndex(spark, f"{spark.sparkContext.getCheckpointDir()}/vectors-{uuid.uuid4().hex}")
    index.build(v.filter("id % 3 = 0"))
    index.add(v.filter("id % 3 <> 0"))
    return index.top_k(v.filter("id % 20 = 0").withColumnRenamed("id", "qid"), 10, 6)


@R.add("rrf_fuse", f"{_RRF} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM best WHERE rank <= 40")
def rrf_fuse(spark, d):
    v, c = corpus(spark, d)
    q = asked(spark, d)
    return retrieval.fuse([retrieval.vector_top_k_batch(v, q, 20, digits=6), retrieval.keyword_top_k(c, q, 20)], 40)


@R.add("hybrid_search", f"{_RRF} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank, source, substr(text, 1, 240) AS snippet FROM best LEFT JOIN documents ON doc_id = id WHERE rank <= 5")
def hybrid_search(spark, d):
    v, c = corpus(spark, d)
    found = retrieval.hybrid(v, c, asked(spark, d), Settings(), digits=6)
    return retrieval.if_few(found, asked(spark, d)).join(c, "id", "left").select("qid", "id", "score", "rank", "source", F.substring("content", 1, 240).alias("snippet"))


@R.add("vector_mode", f"WITH {_VEC} SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM vec WHERE rank <= 5")
def vector_mode(spark, d):
    v, c = corpus(spark, d)
    return retrieval.hybrid(v, c, asked(spark, d), Settings(mode="vector"), digits=6)


@R.add(
    "bm25_topk",
    rf"""WITH q AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}_]+')) AS term FROM ({_ASKED})),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
x AS (SELECT qid, doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN s GROUP BY qid, doc_id)
SELECT qid, id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM x) WHERE rank <= 10""",
)
def bm25_topk(spark, d):
    return retrieval.bm25_top_k(corpus(spark, d)[1], asked(spark, d), 10).select("qid", "id", F.round("score", 4).alias("score"))


@R.add("relevance_floor", f"{_RRF} SELECT qid, id, score FROM best WHERE rank <= 20 AND score >= 0.015")
def relevance_floor(spark, d):
    v, c = corpus(spark, d)
    found = retrieval.hybrid(v, c, asked(spark, d), Settings(top_k_final=20), digits=6)
    return retrieval.relevance_floor(found, 0.015, True).select("qid", "id", "score")


@R.add("context_format", f"{_RRF} SELECT qid, string_agg('[' || CAST(rank AS VARCHAR) || '] (source: ' || source || ', chunk 0)' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM best JOIN documents ON doc_id = id WHERE rank <= 5 GROUP BY qid")
def context_format(spark, d):
    v, c = corpus(spark, d)
    found = retrieval.hybrid(v, c, asked(spark, d), Settings(), digits=6)
    return retrieval.context(retrieval.if_few(found, asked(spark, d)).join(c, "id").withColumn("chunk_index", F.lit(0)))


@R.add("rerank_scores", f"{_RRF}, top AS (SELECT qid, id, rank, length(text) % 97 AS s FROM best JOIN documents ON doc_id = id WHERE rank <= 40), r AS (SELECT qid, id, CAST(s AS DOUBLE) AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank, id) AS rank FROM top) SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def rerank_scores(spark, d):
    v, c = corpus(spark, d)
    q = asked(spark, d)
    found = retrieval.hybrid(v, c, q, Settings(top_k_final=40), digits=6)  # all that either leg found
    wide = retrieval.if_few(found, q).join(c, "id").join(retrieval.if_few(q.select("qid", "query"), q), "qid")
    return retrieval.rerank(wide, lambda qs, cs: [float(len(x) % 97) for x in cs], 5)


def _fused(spark, d):
    v, c = corpus(spark, d)
    q = asked(spark, d)
    found = retrieval.hybrid(v, c, q, Settings(top_k_final=40), digits=6)
    return retrieval.if_few(found, q).join(c, "id").join(retrieval.if_few(q.select("qid", "query"), q), "qid")


class ByLength:
    """Stands in for a hosted service: the score of a text is its length modulo 89, and texts of a remainder below 5 are left out."""

    def __init__(self, key):
        pass

    def of_one(self, query, texts):
        return [float(len(t) % 89) if len(t) % 89 >= 5 else None for t in texts]


@R.add("rerank_service", f"{_RRF}, top AS (SELECT qid, id, rank, length(text) % 89 AS s FROM best JOIN documents ON doc_id = id WHERE rank <= 40), r AS (SELECT qid, id, CAST(s AS DOUBLE) AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rank) AS rank FROM top WHERE s >= 5) SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8")
def rerank_service(spark, d):
    s = Settings(reranker="hosted", reranker_model="length", top_k_final=8)
    return rerankers.apply(_fused(spark, d), s, None, ByLength)


def _third():
    """Stands in for a model: names the passages whose shown part has a length that divides by 3, the last first, and a number out of range."""

    def reply(messages):
        body = messages[0]["content"].partition("Passages:\n")[2]
        parts = re.split(r"(?m)^\[(\d+)\] ", body)[1:]
        sizes = [(int(n), len(t.removesuffix("\n"))) for n, t in zip(parts[::2], parts[1::2], strict=True)]
        return ", ".join(["99", *(str(n) for n, size in reversed(sizes) if size % 3 == 0)])

    return reply


@R.add("rerank_listwise", f"{_RRF}, top AS (SELECT qid, id, score, rank, CASE WHEN least(length(text), 300) % 3 = 0 THEN -rank ELSE rank END AS o FROM best JOIN documents ON doc_id = id WHERE rank <= 12), r AS (SELECT qid, id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY o) AS rank FROM top) SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def rerank_listwise(spark, d):
    return rerankers.by_list(_fused(spark, d), _third, 10).select("qid", "id", F.round("score", 6).alias("score"), "rank")


_SAME = "SELECT vec_id, label FROM embeddings"


def _retrieved(spark, d, k=10):
    e = load(spark, d, "embeddings")
    found = vector_topk_batch(spark, d).join(e.select(F.col("vec_id").alias("id"), "label"), "id")
    lists = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("retrieved"))
    own = e.select(F.col("vec_id").alias("qid"), F.when(F.col("vec_id") % 40 == 0, F.array("label")).otherwise(F.array("label", (F.col("label") + 1) % 10)).alias("relevant"))
    return lists.join(own, "qid")


_LISTS = f"""WITH t AS (SELECT a.vec_id AS qid, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0),
l AS (SELECT qid, list(label ORDER BY rank) AS got FROM t WHERE rank <= 10 GROUP BY qid),
w AS (SELECT l.*, CASE WHEN vec_id % 40 = 0 THEN [label] ELSE [label, (label + 1) % 10] END AS want FROM l JOIN embeddings ON vec_id = qid),
m AS (SELECT qid, len([x FOR x IN want IF list_contains(got, x)]) / CAST(len(want) AS DOUBLE) AS recall,
  coalesce(1.0 / list_min([list_position(got, x) FOR x IN want IF list_contains(got, x)]), 0.0) AS mrr, CASE WHEN len([x FOR x IN want IF list_contains(got, x)]) > 0 THEN 1.0 ELSE 0.0 END AS hit FROM w)"""


@R.add("recall_mrr_hit", f"{_LISTS} SELECT qid, round(recall, 6) AS recall, round(mrr, 6) AS mrr, CAST(hit AS DOUBLE) AS hit FROM m")
def recall_mrr_hit(spark, d):
    s = metrics.per_query(_retrieved(spark, d), 10)
    return s.select("qid", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"), "hit")


@R.add("metrics_summary", f"{_LISTS} SELECT count(*) AS n, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(hit), 6) AS hit FROM m")
def metrics_summary(spark, d):
    return metrics.summary(metrics.per_query(_retrieved(spark, d), 10))


@R.add("config_compare", f"{_LISTS}, c AS (SELECT 1 AS k UNION ALL SELECT 3 UNION ALL SELECT 10), x AS (SELECT k, qid, want, got[1:k] AS got FROM w CROSS JOIN c) SELECT 'vector@' || CAST(k AS VARCHAR) AS config, count(*) AS n, round(avg(len([v FOR v IN want IF list_contains(got, v)]) / CAST(len(want) AS DOUBLE)), 6) AS recall FROM x GROUP BY k")
def config_compare(spark, d):
    """One search for all configurations: a row a question and k, all of one list."""
    base, ks = _retrieved(spark, d), (1, 3, 10)
    for k in ks:
        s = metrics.per_query(base, k)
        base = s.withColumn(f"at{k}", F.struct(F.lit(f"vector@{k}").alias("config"), "relevant", "recall", "mrr", "hit")).drop("recall", "mrr", "hit")
    scored = base.select(F.explode(F.array(*[f"at{k}" for k in ks])).alias("x")).select("x.*")
    return metrics.summary(scored, ["config"]).select("config", "n", "recall")


@R.add("result_match", "SELECT true AS same, false AS other")
def result_match(spark, d):
    n = load(spark, d, "nation")
    a = n.groupBy("n_regionkey").agg(F.avg("n_nationkey").alias("m"))
    b = n.orderBy(F.desc("n_name")).groupBy("n_regionkey").agg((F.sum("n_nationkey") / F.count("*")).alias("m"))
    return spark.createDataFrame([(metrics.same_rows(a, b), metrics.same_rows(a, b.withColumn("m", F.col("m") + 0.01)))], "same boolean, other boolean")
