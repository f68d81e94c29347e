"""Sharding by Karmarkar-Karp differencing: equal texts stay together and shards get nearly equal bytes.

The sizes of groups of equal texts are differenced in blocks: a block starts with one partial partition for each group
(its bytes in one of the shards, zero in the others) and again and again combines the two partial partitions with the
largest spread in opposite order, the heaviest shard of one with the lightest of the other. What a block ends
with is one partial partition of small spread; those of many blocks are combined by the same rule, level by level.
A group larger than a shard's fair part cannot be divided and makes its shard the largest.

Slots count from 0 in each shard without gaps: rows of a shard are dealt to buckets by their place in the input, each
bucket is numbered alone, and the buckets' counts give the offsets, so no task holds a whole shard, whatever ids and texts repeat.

Nulls and odd inputs: a null text has 0 bytes, crc 0 and counts as the empty text. Null ids are allowed. Repeated rows
are one group. Empty tables give empty results. Texts are equal if their SHA-256 are.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, materialize, remove, spread_join

SHARDS = 40
OVERHEAD = 16
#: Groups in a block of the first level, and partial partitions in a block of later levels.
BLOCK, BLOCK_ABOVE = 20_000, 4_000
#: Sums that a block holds, at most (8 bytes each): with many shards blocks get smaller.
CELLS = 4_000_000
#: Rows that are broadcast, at most: under 32 MB at up to 128 bytes each, with the overhead of a hash table.
BROADCAST_ROWS = 250_000
#: Rows of all shards that share a bucket's number, about; a task numbers those of one shard.
BUCKET = 1_000_000


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines partial partitions (rows of sums by label) into one by largest differencing.

    Returns the sums by final label, and for every row the final label of each of its labels.
    """
    n, k = parts.shape
    tops: list[np.ndarray] = []  # sums in rising order
    perms: list[np.ndarray] = []  # perms[i][r]: the label, in the partial partition, that has rank r
    heap: list[tuple[int, int]] = []
    for i in range(n):
        order = np.argsort(parts[i], kind="stable")
        tops.append(parts[i][order])
        heap.append((-int(tops[i][-1] - tops[i][0]), i))
    heapq.heapify(heap)
    joins: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = tops[a] + tops[b][::-1]
        order = np.argsort(total, kind="stable")
        i = len(tops)
        tops.append(total[order])
        tops[a] = tops[b] = None
        joins.append((a, b, order))
        heapq.heappush(heap, (-int(tops[i][-1] - tops[i][0]), i))
    final: list[np.ndarray | None] = [None] * len(tops)
    final[-1] = np.arange(k)  # of each rank, the final label
    for i in range(len(joins) - 1, -1, -1):
        a, b, order = joins[i]
        mine = final[n + i]
        rank_to = np.empty(k, np.int64)
        rank_to[order] = mine  # position before sorting -> final label
        final[a], final[b] = rank_to, rank_to[::-1]
        final[n + i] = None
    out = np.empty((n, k), np.int64)
    for i in range(n):
        out[i, np.argsort(parts[i], kind="stable")] = final[i]
    return tops[-1], out


def _first(shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "digest"], ascending=[False, True], kind="stable")
        parts = np.zeros((len(pdf), shards), np.int64)
        parts[:, 0] = pdf.bytes.to_numpy(np.int64)
        sums, labels = difference(parts)
        return pd.DataFrame({"digest": pdf.digest, "block": pdf.block, "label": labels[:, 0].astype("int32"), "sums": [sums.tolist()] + [None] * (len(pdf) - 1)})

    return run


def _above(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    sums, labels = difference(np.array(pdf.sums.tolist(), np.int64))
    return pd.DataFrame({"block": pdf.block, "up": pdf.up, "labels": [x.tolist() for x in labels], "sums": [sums.tolist()] + [None] * (len(pdf) - 1)})


def assign(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(digest, shard) for groups (digest, bytes)."""
    block, above_block = (max(2, min(most, CELLS // shards)) for most in (BLOCK, BLOCK_ABOVE))
    n = groups.count()
    blocks = max(1, -(-n // block))
    blocked = groups.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks)).cast("int"))
    placed, _ = materialize(blocked.groupBy("block").applyInPandas(_first(shards), "digest binary, block int, label int, sums array<bigint>"), "blocks")
    out = placed.select("digest", "block", "label")
    sums = placed.filter("sums is not null").select("block", "sums")
    while blocks > 1:
        above = -(-blocks // above_block)
        level = sums.withColumn("up", F.pmod("block", F.lit(above)).cast("int"))
        done, _ = materialize(level.groupBy("up").applyInPandas(_above, "block int, up int, labels array<bigint>, sums array<bigint>"), "levels")
        table = few(done.select("block", "up", "labels"), CELLS // shards)  # shards numbers a block
        out = out.join(table, "block").select("digest", F.col("up").alias("block"), F.col("labels")[F.col("label")].cast("int").alias("label"))
        sums = done.filter("sums is not null").select(F.col("up").alias("block"), "sums")
        blocks = above
    return out.select("digest", F.col("label").alias("shard"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (the id, by default), size, text_crc32, law, shard, slot and grown_shard for every row."""
    keep = keep if keep is not None else [id_col]
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(*[F.col(c).alias(f"__in_{c}") for c in keep], F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows, rows_path = materialize(rows, "rows")
    groups, groups_path = materialize(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "groups")
    assigned, assigned_path = materialize(assign(groups, shards).join(groups.select("digest", "rows"), "digest"), "assigned")
    placed = spread_join(rows, assigned, "digest", "rows", F.xxhash64("row"), bound=BROADCAST_ROWS)
    buckets = max(1, -(-rows.count() // BUCKET))
    placed, _ = materialize(placed.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int")).drop("digest"), "placed")
    remove(docs.sparkSession, rows_path, groups_path, assigned_path)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    offsets = counts.select("shard", "bucket", before.alias("before"))
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("row")))
    out = numbered.join(offsets, ["shard", "bucket"])
    return out.select(*[F.col(f"__in_{c}").alias(c) for c in keep], *[F.col(c) for c in ("size", "text_crc32") if c not in keep], F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
