"""Retrieval for batches of questions: vector and keyword legs, rank fusion, reranking.

Results have (qid, id, score, rank), rank from 1; ties go to the smaller id.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import Settings
from ..functions.text import tokens
from .topk import top_k

#: Questions up to this number are broadcast at once (a vector or some words each); more are taken in blocks.
QUESTION_BLOCK = 4096
#: Questions whose scores with a batch of vectors are in a worker's memory at once.
TILE = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 where a norm is 0."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / F.when(n > 0, n)).otherwise(0.0)


def vector_top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """(id, score) of the k nearest by cosine to one query vector: a scan and a take-ordered, no shuffle of vectors."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = float(np.sqrt(sum(float(x) ** 2 for x in query)))
    n = F.sqrt(dot(F.col(vec_col), F.col(vec_col))) * (norm or 1.0)
    score = F.when(n > 0, dot(F.col(vec_col), q) / F.when(n > 0, n)).otherwise(0.0)
    return vectors.select(F.col(id_col).alias("id"), score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles."""
    flat = vectors.flatten()
    if vectors.null_count or flat.null_count or len(pc.unique(pc.list_value_length(vectors))) != 1:
        return np.array(vectors.to_pylist(), float)
    return flat.to_numpy().astype(float, copy=False).reshape(len(vectors), -1)


def _first(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first of each row, by descending score, then id."""
    order = np.lexsort((ids, -score, row))
    sorted_row = row[order]
    starts = np.flatnonzero(np.diff(sorted_row, prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < k]


def nearest(batches, qids: list, q: np.ndarray, k: int, digits: int | None, schema: pa.Schema):
    """Record batches (qid, id, score) of the k vectors nearest to each of the unit rows of q, among all batches (id, vector).

    Besides one tile of scores a worker holds k places a question, as arrays.
    """
    none = (np.empty(0, "int64"), np.empty(0), np.empty(0, "int64"))
    tiles = range(0, len(qids), TILE)
    best, names = [none] * len(tiles), pa.array([], schema.field("id").type)
    for b in batches:
        if not b.num_rows:
            continue
        # ids by their place among the ids of this batch and those found so far
        both = pa.concat_arrays([names, b.column(0).cast(names.type)])
        values = pc.unique(both)
        values = values.take(pc.sort_indices(values))
        code = pc.index_in(both, value_set=values).to_numpy()
        old, new = code[: len(names)], code[len(names) :]
        v = _matrix(b.column(1))
        n = np.linalg.norm(v, axis=1)
        for t, at in enumerate(tiles):
            s = q[at : at + TILE] @ v.T
            s /= np.where(n > 0, n, 1)
            s[np.isnan(s)] = -np.inf
            if digits is not None:
                np.round(s, digits, out=s)
                s += 0.0
            least = np.partition(s, len(new) - k, axis=1)[:, len(new) - k] if len(new) > k else np.full(len(s), -np.inf)
            row, col = np.nonzero((s >= least[:, None]) & (s > -np.inf))  # with all ties
            r, x, i = best[t]
            r, x, i = np.concatenate([r, row]), np.concatenate([x, s[row, col]]), np.concatenate([old[i], new[col]])
            keep = _first(r, x, i, k)
            best[t] = r[keep], x[keep], i[keep]
        used = np.unique(np.concatenate([i for _, _, i in best]))
        best = [(r, x, np.searchsorted(used, i)) for r, x, i in best]
        names = values.take(pa.array(used))
    asked = pa.array(qids, schema.field("qid").type)
    for at, (r, x, i) in zip(tiles, best, strict=True):
        yield pa.RecordBatch.from_arrays([asked.take(pa.array(r + at)), names.take(pa.array(i)), pa.array(x)], schema=schema)


def vector_top_k_batch(vectors: DataFrame, questions: DataFrame, k: int, id_col: str = "id", vec_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """(qid, id, score, rank) for questions (qid, embedding): blocked matrix products, the k best of each task, then the k best.

    Questions are few (a stated set) and collected in blocks of bounded size; vectors are never shuffled, only
    k results a question and task.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    qkind = questions.schema["qid"].dataType.simpleString()
    arrow = pa.schema([("qid", to_arrow_type(questions.schema["qid"].dataType)), ("id", to_arrow_type(vectors.schema[id_col].dataType)), ("score", pa.float64())])
    rows = iter(questions.select("qid", F.col("embedding").cast("array<double>").alias("embedding")).toLocalIterator())
    out = None
    while block := [(r.qid, r.embedding) for r in itertools.islice(rows, QUESTION_BLOCK)]:
        m = np.array([v for _, v in block], float)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        shared = vectors.sparkSession.sparkContext.broadcast(([q for q, _ in block], m / np.where(norms > 0, norms, 1)))

        def run(batches, shared=shared):
            yield from nearest(batches, *shared.value, k, digits, arrow)

        part = vectors.select(id_col, F.col(vec_col).cast("array<double>")).mapInArrow(run, f"qid {qkind}, id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"qid {qkind}, id {kind}, score double, rank int")
    return top_k(out, ["qid"], [F.desc("score"), F.col("id")], k)


def postings(chunks: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(term, id, tf): an inverted list, to be stored partitioned by a hash of the term for repeated use."""
    return chunks.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def question_terms(questions: DataFrame) -> DataFrame:
    """Distinct (qid, term) of questions (qid, query)."""
    return questions.select("qid", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))


def if_few(terms: DataFrame, questions: DataFrame) -> DataFrame:
    """What comes from the questions, to be broadcast if there are at most QUESTION_BLOCK of these."""
    return F.broadcast(terms) if questions.limit(QUESTION_BLOCK + 1).count() <= QUESTION_BLOCK else terms


def keyword_top_k(chunks: DataFrame, questions: DataFrame, k: int, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(qid, id, score, rank): 0.1 for every position of a chunk that holds a term of the question (terms are OR-ed).

    There is no inverse document frequency and no length norm: the cover density of a pure OR query. Question terms
    are broadcast when there are at most QUESTION_BLOCK questions; counts are combined in each task before the shuffle.
    """
    terms = if_few(question_terms(questions), questions)
    at = chunks.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term"))
    scored = at.join(terms, "term").groupBy("qid", "id").agg(F.count("*").alias("n")).select("qid", "id", F.round(F.col("n") * 0.1, 6).alias("score"))
    return top_k(scored, ["qid"], [F.desc("score"), F.col("id")], k)


def bm25_top_k(chunks: DataFrame, questions: DataFrame, k: int, id_col: str = "id", text_col: str = "content", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Extension: Okapi BM25 instead of cover density."""
    sized = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    stats = sized.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg_len")).first()
    terms = if_few(question_terms(questions), questions)
    tf = sized.select("id", F.size("t").alias("len"), F.explode("t").alias("term")).join(if_few(question_terms(questions).select("term").distinct(), questions), "term").groupBy("term", "id", "len").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (stats.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(stats.avg_len or 1.0)))
    scored = tf.join(df, "term").join(terms, "term").groupBy("qid", "id").agg(F.round(F.sum(gain), 6).alias("score"))
    return top_k(scored, ["qid"], [F.desc("score"), F.col("id")], k)


def rrf(legs: list[DataFrame], k: int = 60, by: str = "qid", key: str = "id") -> DataFrame:
    """(qid, id, score): reciprocal rank fusion of legs (qid, id, rank); leg and best_rank say where a row was first seen."""
    union = None
    for i, leg in enumerate(legs):
        x = leg.select(by, key, "rank", F.lit(i).alias("leg"))
        union = x if union is None else union.unionByName(x)
    return union.groupBy(by, key).agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))


def fuse(legs: list[DataFrame], limit: int, k: int = 60) -> DataFrame:
    """(qid, id, score, rank): the best of the fusion; ties in the order in which rows were first seen."""
    return top_k(rrf(legs, k), ["qid"], [F.desc("score"), F.col("first.leg"), F.col("first.rank"), F.col("id")], limit).drop("first")


def rerank(results: DataFrame, pairs: Callable[[list[str], list[str]], list[float]] | None, limit: int, candidates: int | None = None) -> DataFrame:
    """(qid, id, score, rank): new scores from ``pairs(queries, contents)``, best first; without a scorer the first ``limit`` stay.

    results: qid, id, score, rank and, with a scorer, query and content. ``candidates`` limits what is scored.
    """
    if pairs is None:
        return results.filter(F.col("rank") <= limit).select("qid", "id", "score", "rank")
    src = results if candidates is None else results.filter(F.col("rank") <= candidates)
    base = src.select("qid", "id", "rank", "query", "content")
    kinds = {c: base.schema[c].dataType.simpleString() for c in ("qid", "id", "rank")}

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"qid": pdf.qid, "id": pdf.id, "before": pdf["rank"], "score": np.asarray(pairs(list(pdf["query"]), list(pdf.content)), float)})

    scored = base.mapInPandas(run, f"qid {kinds['qid']}, id {kinds['id']}, before {kinds['rank']}, score double")
    return top_k(scored, ["qid"], [F.desc("score"), F.col("before"), F.col("id")], limit).drop("before")


def relevance_floor(results: DataFrame, floor: float | None, calibrated: bool) -> DataFrame:
    """Results with at least the floor; only scores of a cross-encoder are comparable, others pass."""
    return results if floor is None or not calibrated else results.filter(F.col("score") >= floor)


def hybrid(vectors: DataFrame, chunks: DataFrame, questions: DataFrame, settings: Settings = Settings(), digits: int | None = None) -> DataFrame:  # noqa: B008
    """(qid, id, score, rank) for questions (qid, query, embedding).

    Mode ``vector`` skips fusion; ``hybrid`` fuses the vector and the keyword leg.
    """
    v = vector_top_k_batch(vectors, questions, settings.top_k_vector if settings.mode == "hybrid" else settings.top_k_final, digits=digits)
    if settings.mode == "vector":
        return v
    return fuse([v, keyword_top_k(chunks, questions, settings.top_k_keyword)], settings.top_k_final, settings.rrf_k)


def context(results: DataFrame) -> DataFrame:
    """(qid, context): numbered sources in the order of rank; needs source, chunk_index and content."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] (source: "), F.col("source"), F.lit(", chunk "), F.col("chunk_index").cast("string"), F.lit(")\n"), F.col("content"))
    listed = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    return listed.select("qid", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))
