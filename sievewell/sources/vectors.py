"""A stored index of vectors: clusters with bounds, searched exactly.

Vectors lie in Parquet, a folder for each cluster, beside each cluster's size and radius (the largest angle between a vector
of it and its centre). No vector of a cluster is nearer to a question than the angle to the centre less the radius, so a
search scores the clusters nearest to a question, takes its k-th score, and then reads only clusters whose bound reaches it. The
result is that of a whole scan.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.retrieval import QUESTION_BLOCK
from ..operators.topk import top_k
from .store import Versioned

#: Vectors that centres are found from, the most centres, and rounds. Every vector is indexed, whatever the sample holds.
SAMPLE, CLUSTERS, ROUNDS = 20_000, 2048, 8
#: Vectors of one cluster that a task writes.
ROWS = 1_000_000
#: Angles are known about so well.
SLACK = 1e-6
#: The cluster of vectors without a direction; their similarity is 0.
ZERO = -1
#: The cluster of all others where there are no centres; its bound is 1.
REST = -2


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def centres_of(sample: np.ndarray, clusters: int) -> np.ndarray:
    """Centres on the unit sphere by k-means, from evenly spaced rows; a centre that loses all its rows stays where it was."""
    x = _unit(sample[np.linalg.norm(sample, axis=1) > 0])
    if not len(x):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    c = x[np.unique(np.linspace(0, len(x) - 1, min(clusters, len(x))).astype(int))]
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(length > 0, sums / np.where(length > 0, length, 1), c)
    return c


class VectorIndex:
    """The index at a path. ``build`` starts it anew, ``add`` puts more vectors to the same centres; of two writers at once one fails.

    Vectors that are null, of another length, or hold null or non-finite numbers are left out; ids must be unique.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint"):
        self.spark, self.path = spark, path.rstrip("/")
        self.schemas = {"stats": "cluster int, n bigint, radius double", "vectors": f"id {id_type}, embedding array<double>, cluster int", "centres": "cluster int, centre array<double>"}
        self.segments = Versioned(spark, f"{self.path}/manifest", "segment string, first boolean")

    # --- writing ---

    def build(self, vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding", clusters: int | None = None) -> None:
        self.segments.read()
        src = self._usable(vectors, id_col, vec_col)
        sample = [r.embedding for r in src.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("embedding").collect()]
        wanted = clusters or int(min(CLUSTERS, max(1, round(src.count() ** 0.5))))
        dims = len(sample[0]) if sample else 0
        same = [v for v in sample if len(v) == dims]
        c = centres_of(np.array(same, float).reshape(len(same), dims), wanted)
        name = f"s-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(c)], "cluster int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/{name}/centres")
        self._write(src, name, c)
        self.segments.replace(self.spark.createDataFrame([(name, True)], self.segments.schema).coalesce(1))

    def add(self, vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> None:
        had = self.segments.read()
        name = f"s-{uuid.uuid4().hex}"
        self._write(self._usable(vectors, id_col, vec_col), name, self._centres(had))
        self.segments.replace(had.unionByName(self.spark.createDataFrame([(name, False)], self.segments.schema)).coalesce(1))

    def _usable(self, vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("embedding")).filter("embedding is not null and size(embedding) > 0").filter(finite)

    def _write(self, src: DataFrame, name: str, centres: np.ndarray) -> None:
        kind = src.schema["id"].dataType
        shared = self.spark.sparkContext.broadcast(centres)  # CLUSTERS vectors at most
        arrow = pa.schema([("id", to_arrow_type(kind)), ("embedding", pa.list_(pa.float64())), ("cluster", pa.int32()), ("angle", pa.float64())])

        def assign(batches):
            c = shared.value
            for b in batches:
                b = b.filter(pa.array([len(v) == c.shape[1] for v in b.column(1).to_pylist()], pa.bool_())) if len(c) else b
                v = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
                some = np.linalg.norm(v, axis=1) > 0
                near, angle = np.where(some, REST, ZERO), np.where(some, np.pi, 0.0)
                if len(c) and len(v):
                    s = _unit(v) @ c.T
                    near = np.where(some, np.argmax(s, axis=1), ZERO)
                    angle = np.where(some, np.arccos(np.clip(s.max(axis=1), -1, 1)), 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.list_(pa.float64())), pa.array(near, pa.int32()), pa.array(angle)], schema=arrow)

        at = src.mapInArrow(assign, f"id {kind.simpleString()}, embedding array<double>, cluster int, angle double")
        at.write.parquet(f"{self.path}/{name}/assigned")
        done = self.spark.read.parquet(f"{self.path}/{name}/assigned")
        stats = done.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        stats.coalesce(1).write.parquet(f"{self.path}/{name}/stats")
        parts = self.spark.read.parquet(f"{self.path}/{name}/stats").select("cluster", F.ceil(F.col("n") / ROWS).alias("__parts"))
        split = done.join(F.broadcast(parts), "cluster")  # a row a cluster
        split.repartition("cluster", F.pmod(F.xxhash64("id"), F.col("__parts"))).select("cluster", "id", "embedding").write.partitionBy("cluster").parquet(f"{self.path}/{name}/vectors")

    # --- reading ---

    def _centres(self, segments: DataFrame) -> np.ndarray:
        first = segments.filter("first").first()
        if first is None:
            raise ValueError(f"{self.path}: nothing is built")
        rows = self.spark.read.schema(self.schemas["centres"]).parquet(f"{self.path}/{first.segment}/centres").orderBy("cluster").collect()
        return np.array([r.centre for r in rows], float)

    def _read(self, what: str) -> DataFrame:
        out = self.spark.createDataFrame([], self.schemas[what])
        for r in self.segments.read().orderBy("segment").collect():
            df = self.spark.read.schema(self.schemas[what]).parquet(f"{self.path}/{r.segment}/{what}")
            out = out.unionByName(df)
        return out

    def top_k(self, questions: DataFrame, k: int, digits: int | None = None) -> DataFrame:
        """(qid, id, score, rank) as operators.retrieval.vector_top_k_batch gives for questions (qid, embedding)."""
        return self.search(questions, k, digits)[0]

    def search(self, questions: DataFrame, k: int, digits: int | None = None) -> tuple[DataFrame, dict]:
        """The result, and the shares of vectors read and of (question, vector) pairs scored, those of the first look included."""
        stats = {r.cluster: (r.n, r.radius) for r in self._read("stats").groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()}
        centres = self._centres(self.segments.read())
        names = np.array(sorted(stats), int)
        sizes, radius = (np.array([stats[c][i] for c in names], float) for i in (0, 1))
        total, vectors = float(sizes.sum()), self._read("vectors")
        kind, qkind = vectors.schema["id"].dataType.simpleString(), questions.schema["qid"].dataType.simpleString()
        out, block = self.spark.createDataFrame([], f"qid {qkind}, id {kind}, score double"), []
        used = {"questions": 0, "read": 0.0, "scored": 0.0}

        def take(block: list) -> None:
            nonlocal out
            m = _unit(np.array([v for _, v in block], float))
            qids = [q for q, _ in block]
            cos = np.zeros((len(m), len(names)))
            real = names >= 0
            if real.any():
                cos[:, real] = m @ centres[names[real]].T
            gap = np.maximum(0, np.arccos(np.clip(cos, -1, 1)) - radius - SLACK)
            bound = np.where((names != ZERO) & (np.linalg.norm(m, axis=1, keepdims=True) > 0), np.cos(gap), 0.0)
            order = np.argsort(-np.where(real, cos, -2.0), axis=1, kind="stable")
            first = np.zeros_like(bound, bool)
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            np.put_along_axis(first, order, before < k, axis=1)  # the nearest clusters that hold k vectors together
            looked = self._score(vectors, qids, m, names, first, k, digits, kind, qkind)
            least = dict(looked.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") >= k).select("qid", "least").collect())
            floor = np.array([least.get(q, -2.0) for q in qids])[:, None] - SLACK - (10.0**-digits if digits is not None else 0)
            need = bound >= floor
            out = out.unionByName(self._score(vectors, qids, m, names, need, k, digits, kind, qkind).select("qid", "id", "score"))
            used["questions"] += len(block)
            used["read"] = max(used["read"], float(sizes[(need | first).any(axis=0)].sum()) / max(total, 1.0))
            used["scored"] += float(((need | first) @ sizes).sum())

        for r in questions.select("qid", F.col("embedding").cast("array<double>").alias("embedding")).toLocalIterator():
            block.append((r.qid, r.embedding))
            if len(block) >= QUESTION_BLOCK:
                take(block)
                block = []
        if block and len(names):
            take(block)
        used["scored"] /= max(1.0, used["questions"] * total)
        return top_k(out, ["qid"], [F.desc("score"), F.col("id")], k), used

    def _score(self, vectors: DataFrame, qids: list, m: np.ndarray, names: np.ndarray, need: np.ndarray, k: int, digits: int | None, kind: str, qkind: str) -> DataFrame:
        """(qid, id, score, rank): the k best of each question among the vectors of the clusters that it needs; other clusters' folders are not read."""
        wanted = {int(c): np.flatnonzero(need[:, j]) for j, c in enumerate(names) if need[:, j].any()}
        shared = self.spark.sparkContext.broadcast((qids, m, wanted))
        arrow = pa.schema([("qid", to_arrow_type(self.spark.createDataFrame([], f"q {qkind}").schema["q"].dataType)), ("id", to_arrow_type(vectors.schema["id"].dataType)), ("score", pa.float64())])

        def run(batches):
            qids, q, wanted = shared.value
            best: list[list[tuple]] = [[] for _ in qids]
            for b in batches:
                where, ids = b.column(0).to_numpy(), b.column(1).to_pylist()
                v = np.array(b.column(2).to_pylist(), float).reshape(len(ids), -1)
                n = np.linalg.norm(v, axis=1)
                for c in np.unique(where):
                    rows, asked = np.flatnonzero(where == c), wanted[int(c)]
                    s = q[asked] @ v[rows].T / np.where(n[rows] > 0, n[rows], 1)
                    if digits is not None:
                        s = np.round(s, digits) + 0.0
                    for i, row in zip(asked, s, strict=True):
                        at = np.argpartition(-row, k - 1)[:k] if len(row) > k else np.arange(len(row))
                        at = np.flatnonzero(row >= row[at].min())  # with all ties
                        best[i] = sorted([*best[i], *((-row[j], ids[rows[j]]) for j in at)])[:k]
            found = [(qids[i], x, -s) for i, rows in enumerate(best) for s, x in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(arrow)], schema=arrow)

        src = vectors.filter(F.col("cluster").isin(*wanted)) if wanted else vectors.limit(0)
        return top_k(src.select("cluster", "id", "embedding").mapInArrow(run, f"qid {qkind}, id {kind}, score double"), ["qid"], [F.desc("score"), F.col("id")], k)
