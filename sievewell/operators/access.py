"""Extension: access control of documents, by groups, applied inside each retrieval leg before it ranks.

Principals are members of groups and groups of groups; grants give groups to resources (sources). Tables of members and
grants stay tables: closures and divisions are joins and aggregates, and no list of a group's members is gathered.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import Settings
from . import graph, retrieval
from .retrieval import QUESTION_BLOCK, if_few
from .topk import top_k

#: Grants (a source and a group) that are broadcast, at most; more are joined by shuffle.
BROADCAST_GRANTS = 100_000


def _written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again."""
    graph.ensure_checkpoint_dir(df)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/access-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(members: DataFrame) -> DataFrame:
    """(member, grp): all groups that each member is in, also through other groups; members has (member, grp), cycles are allowed.

    Each round joins what the last one found with the direct memberships and keeps what is new; it is written, which cuts the lineage.
    """
    edges = _written(members.select("member", "grp").filter("member is not null and grp is not null").distinct())
    known = new = edges
    while True:
        step = new.alias("n").join(edges.alias("e"), F.col("n.grp") == F.col("e.member")).select(F.col("n.member").alias("member"), F.col("e.grp").alias("grp")).distinct()
        new = _written(step.join(known, ["member", "grp"], "left_anti"))
        if new.isEmpty():
            return known
        known = _written(known.unionByName(new))


def allowed(principals: DataFrame, members: DataFrame, grants: DataFrame) -> DataFrame:
    """(principal, source): what each principal may read; grants has (source, grp), a principal is a group of its own."""
    groups = closure(members).join(principals.select(F.col("principal").alias("member")).distinct(), "member", "left_semi").withColumnRenamed("member", "principal")
    own = principals.select("principal", F.col("principal").alias("grp")).distinct()
    return groups.unionByName(own).join(grants.select("source", "grp").distinct(), "grp").select("principal", "source").distinct()


def _granted(chunks: DataFrame, grants: DataFrame) -> DataFrame:
    """chunks with acl, the groups that their source is granted to; those granted to none are left out."""
    acl = grants.groupBy("source").agg(F.collect_set("grp").alias("acl"))  # as many as a source's grants
    return chunks.join(F.broadcast(acl) if grants.limit(BROADCAST_GRANTS + 1).count() <= BROADCAST_GRANTS else acl, "source")


def _asked(questions: DataFrame, members: DataFrame) -> DataFrame:
    """questions with grps, the principal's groups and itself."""
    groups = closure(members).join(questions.select(F.col("principal").alias("member")).distinct(), "member", "left_semi")
    lists = groups.groupBy(F.col("member").alias("principal")).agg(F.collect_set("grp").alias("grps"))  # as many as a principal's groups
    return questions.join(lists, "principal", "left").withColumn("grps", F.array_union(F.coalesce("grps", F.array().cast("array<string>")), F.array("principal")))


def keyword_leg(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """keyword_top_k among the chunks that each question's principal may read: (qid, id, score, rank).

    chunks: id, content, acl; questions: qid, query, grps. The lists are compared where terms meet, before counts and ranks.
    """
    terms = retrieval.question_terms(questions).join(questions.select("qid", "grps"), "qid")
    at = chunks.select("id", "acl", F.explode(retrieval.tokens(F.col("content"))).alias("term"))
    seen = at.join(if_few(terms, questions), "term").filter(F.arrays_overlap("acl", "grps"))
    scored = seen.groupBy("qid", "id").agg(F.count("*").alias("n")).select("qid", "id", F.round(F.col("n") * 0.1, 6).alias("score"))
    return top_k(scored, ["qid"], [F.desc("score"), F.col("id")], k)


def vector_leg(vectors: DataFrame, questions: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """vector_top_k_batch among the vectors that each question's principal may read: (qid, id, score, rank).

    vectors: id, embedding, acl; questions: qid, embedding, grps. In each task the scores of unreadable vectors are
    set aside before the k best are chosen, so hidden rows take no places. Questions are taken block by block.
    """
    kind, qkind = vectors.schema["id"].dataType.simpleString(), questions.schema["qid"].dataType.simpleString()
    arrow = pa.schema([("qid", to_arrow_type(questions.schema["qid"].dataType)), ("id", to_arrow_type(vectors.schema["id"].dataType)), ("score", pa.float64())])
    src = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"), "acl")
    out, block = None, []

    def leg(rows: list) -> DataFrame:
        groups = {g: i for i, g in enumerate(sorted({g for r in rows for g in r.grps}))}
        member = np.zeros((len(rows), len(groups)), np.float32)
        for i, r in enumerate(rows):
            member[i, [groups[g] for g in r.grps]] = 1
        q = np.array([r.embedding for r in rows], float)
        norms = np.linalg.norm(q, axis=1, keepdims=True)
        q, qids = q / np.where(norms > 0, norms, 1), [r.qid for r in rows]

        def run(batches):
            best: list[list[tuple]] = [[] for _ in qids]
            for b in batches:
                ids = b.column(0).to_pylist()
                if not ids:
                    continue
                v = np.array(b.column(1).to_pylist(), float)
                granted = np.zeros((len(ids), len(groups)), np.float32)
                for i, acl in enumerate(b.column(2).to_pylist()):
                    granted[i, [groups[g] for g in acl if g in groups]] = 1
                n = np.linalg.norm(v, axis=1)
                s = q @ v.T / np.where(n > 0, n, 1)
                if digits is not None:
                    s = np.round(s, digits) + 0.0
                visible = member @ granted.T > 0
                for i, row in enumerate(s):
                    may = np.flatnonzero(visible[i])
                    if len(may) > k:  # with all ties
                        may = may[row[may] >= np.partition(row[may], len(may) - k)[len(may) - k]]
                    best[i] = sorted([*best[i], *((-row[j], ids[j]) for j in may)])[:k]
            rows = [(qids[i], x, -s) for i, found in enumerate(best) for s, x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

        return src.mapInArrow(run, f"qid {qkind}, id {kind}, score double")

    for r in questions.select("qid", F.col("embedding").cast("array<double>").alias("embedding"), "grps").toLocalIterator():
        block.append(r)
        if len(block) == QUESTION_BLOCK:
            out, block = leg(block) if out is None else out.unionByName(leg(block)), []
    if block or out is None:
        out = (leg(block) if out is None else out.unionByName(leg(block))) if block else vectors.sparkSession.createDataFrame([], f"qid {qkind}, id {kind}, score double")
    return top_k(out, ["qid"], [F.desc("score"), F.col("id")], k)


def hybrid(vectors: DataFrame, chunks: DataFrame, questions: DataFrame, members: DataFrame, grants: DataFrame, settings: Settings = Settings(), digits: int | None = None) -> DataFrame:  # noqa: B008
    """(qid, id, score, rank) as retrieval.hybrid, of what each question's principal may read.

    vectors: id, embedding; chunks: id, content, source; questions: qid, query, embedding, principal. Both legs filter
    before they rank, so rows that a principal may not read change neither its ranks nor its scores.
    """
    mine = _asked(questions, members)
    known = _granted(chunks, grants)
    v = vector_leg(vectors.join(known.select("id", "acl"), "id"), mine, settings.top_k_vector if settings.mode == "hybrid" else settings.top_k_final, digits)
    if settings.mode == "vector":
        return v
    return retrieval.fuse([v, keyword_leg(known, mine, settings.top_k_keyword)], settings.top_k_final, settings.rrf_k)


def visible_communities(communities: DataFrame, may: DataFrame) -> DataFrame:
    """(principal, community): communities all of whose sources the principal may read, so that no summary tells of others.

    communities has (community, source), may has (principal, source). A division: the sources that a principal may read
    are counted for each community and must be all it has. Communities without sources are not visible.
    """
    pairs = communities.select("community", "source").distinct()
    need = pairs.filter("source is not null").groupBy("community").agg(F.count("*").alias("need"))
    hidden = pairs.filter("source is null").select("community")  # an unknown source can't be allowed
    have = pairs.join(may.select("principal", "source").distinct(), "source").groupBy("principal", "community").agg(F.count("*").alias("have"))
    return have.join(need, "community").filter("have = need").join(hidden, "community", "left_anti").select("principal", "community")


def leakage(results: DataFrame, may: DataFrame) -> DataFrame:
    """(principal, n, leaks, leak_rate): cited sources that the principal may not read. results: (principal, source), a row for each citation."""
    ok = may.select("principal", "source").distinct().withColumn("ok", F.lit(1))
    judged = results.select("principal", "source").join(ok, ["principal", "source"], "left")
    out = judged.groupBy("principal").agg(F.count("*").alias("n"), F.sum(F.when(F.col("ok").isNull(), 1).otherwise(0)).alias("leaks"))
    return out.withColumn("leak_rate", F.col("leaks") / F.col("n"))


def false_denials(relevant: DataFrame, results: DataFrame, may: DataFrame) -> DataFrame:
    """(principal, readable, found, recall): of the relevant rows (principal, qid, id, source) that the principal may read, those among its results (qid, id)."""
    mine = relevant.join(may.select("principal", "source").distinct(), ["principal", "source"], "left_semi")
    got = mine.join(results.select("qid", "id").distinct().withColumn("got", F.lit(1)), ["qid", "id"], "left")
    out = got.groupBy("principal").agg(F.count("*").alias("readable"), F.count("got").alias("found"))
    return out.withColumn("recall", F.col("found") / F.col("readable"))
