"""Connected components of a distributed edge table: alternating large-star and small-star rounds.

A table of TASK_EDGES edges or fewer is solved by one task instead, in a few array operations: 16 bytes an edge are
read and the work is bounded, where each round would be several jobs. Both ways give the same result, and rounds on a
large table end as soon as what is left of it is that small.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove, spread_join


#: Edges up to which the table of least neighbours, two rows an edge at most, is broadcast: under 32 MB with overhead.
BROADCAST_EDGES = 250_000


#: Edges that one task solves: 4 MB, some 20 MB while it works.
TASK_EDGES = 250_000


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the places 0 to n - 1 that each is connected with by pairs (a, b): roots are hooked under smaller ones, then paths are halved to nothing."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (nxt := label[label]).tobytes() != label.tobytes():
            label = nxt


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(a, b) with b the least node that a is connected with, for all nodes but those that are least."""

    def run(batches):
        cols = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if cols:
            ends = np.concatenate([np.concatenate(x) for x in zip(*cols, strict=True)])
            nodes, at = np.unique(ends, return_inverse=True)
            label = least_labels(len(nodes), at[: len(at) // 2], at[len(at) // 2 :])
            more = np.flatnonzero(label != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[more]), pa.array(nodes[label[more]])], ["a", "b"])

    return edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).coalesce(1).mapInArrow(run, "a bigint, b bigint")


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """edges (a, b), made from n, with m, the least b of each a. Nodes with very many edges are split, see spread_join."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("rows"))
    if n <= BROADCAST_EDGES:
        return edges.join(F.broadcast(least.drop("rows")), "a")
    return spread_join(edges, materialize(least, "least")[0], "a", "rows", F.xxhash64("b"), bound=0)


def _stars(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One round: every node points its neighbours (the larger ones, or the smaller ones and itself) to its least neighbour.

    The least neighbour comes from a partial aggregate and goes back by a join, so no node's neighbours are gathered.
    """
    if large:
        sym = _with_least(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), n)
        out = sym.filter("b > a").select(F.col("b").alias("x"), F.least("m", "a").alias("y"))
    else:
        joined = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), n)
        out = joined.select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(joined.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def connected_components(edges: DataFrame, made: list[str] | None = None) -> DataFrame:
    """(id, root) for every node of ``edges`` (a, b): root is the least node that it is connected with.

    Each round is written to the shared folder, which cuts the lineage. It ends when a round changes no edge. The path of
    the table that the result reads is added to ``made``, for the caller to remove.
    """
    spark = edges.sparkSession
    cur, path = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    while True:
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if last == (state.n, state.h) or not state.n:
            break
        last, small = (state.n, state.h), state.n <= TASK_EDGES
        nxt, new = materialize(_in_one_task(cur) if small else _stars(_stars(cur, True, state.n), False, state.n), "edges")
        remove(spark, path)
        cur, path = nxt, new
        if small:
            break
    if made is not None:
        made.append(path)
    # now every node other than the roots has one edge, to its root
    return cur.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
