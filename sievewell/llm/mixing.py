"""Mixing sources to target weights by cube-method balanced sampling.

A source's target is its share of the words wanted, at most ``CAP`` times what it has. Every document is taken
floor(r) times, r being target / size of its source, and once more with probability r - floor(r). These inclusion
probabilities are rounded by the cube method: they move at random along the null-space of two constraints per source
(words and documents taken), so both totals stay exactly on target until at most two documents of a source are still
open. That flight runs in blocks of a source's documents, large ones first, each leaving at most two documents open;
what is left of many blocks is a block of the next round. The landing settles the last open documents and a few others
together, in the way that brings the words nearest to the target.

Block membership and random numbers come from hashes of ids and of the round, so reruns agree.

Where very many rows share id and size, their block is split by their places in the input. Sources are a table that
may be of any length: targets are found by a few sums over it.

Nulls and odd inputs: a null or wordless text has size 0; such a document weighs in the number of documents only. A
null source is one of its own, after all others. Rows that repeat id and size are interchangeable. A source without
words gets target 0 and nothing is taken. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.topk import numbered
from .common import ROWS_A_SALT, WORD, few, materialize, shared_dir, spread_join

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: Documents of one source in a block of the flight.
BLOCK = 5_000
#: What is left of a source is landed at once when it is not more.
LANDING = 5_000
#: Documents of a source, of all sizes, that the landing settles together with what a flight leaves open.
LAST = 11
#: Rows that are broadcast, at most: under 32 MB at up to 128 bytes each, with the overhead of a hash table.
BROADCAST_ROWS = 250_000
EPS = 1e-9


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sources (source, size, ...) with target: shares by weight of ``share`` of all words; what is over ``cap`` times a
    source's size is shared again among the others, by weight, until none is over. Sources by code point, null last, take the weights in turn.

    Each round of sharing is a sum over the table: the unit of weight rises as sources meet their caps, and they keep them.
    """
    shared_dir(sources.sparkSession)  # for checkpoints
    ranked = numbered(sources, [F.col("source").isNull(), F.col("source")])
    ranked, _ = materialize(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))).drop("number"), "weights")
    total, unit, before = ranked.agg(F.sum("size")).first()[0] or 0, 0.0, -1
    while True:
        over = F.col("size") * cap < F.col("weight") * F.lit(unit)
        r = ranked.agg(F.count(F.when(over, 1)).alias("n"), F.coalesce(F.sum(F.when(over, F.col("size"))), F.lit(0)).alias("size"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if r.n == before or not r.weight:
            break
        before, unit = r.n, (share * total - cap * r.size) / r.weight
    return ranked.withColumn("target", F.least(F.col("size") * cap, F.col("weight") * F.lit(unit))).drop("weight")


def flight(prob: np.ndarray, size: np.ndarray, rand: np.random.Generator) -> np.ndarray:
    """Moves probabilities along directions that keep their sum and their size-weighted sum, until at most two are open.

    Three open units always have such a direction: the cross product of (1, 1, 1) and their sizes. Each step goes
    to one of the two ends of the segment inside the cube, with the chances that keep every expectation.
    """
    p, s = prob.tolist(), size.tolist()
    draws = iter(rand.random(len(p) + 1).tolist())
    hand: list[int] = []
    for i, x in enumerate(p):
        if not EPS < x < 1 - EPS:
            p[i] = round(x)
            continue
        hand.append(i)
        if len(hand) < 3:
            continue
        a, b, c = hand
        u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
        if u == (0.0, 0.0, 0.0):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for j, d in zip(hand, u, strict=True):
            if d > 0:
                up, down = min(up, (1 - p[j]) / d), min(down, p[j] / d)
            elif d < 0:
                up, down = min(up, -p[j] / d), min(down, (p[j] - 1) / d if d else down)
        step = up if next(draws) * (up + down) < down else -down
        still = []
        for j, d in zip(hand, u, strict=True):
            p[j] = min(1.0, max(0.0, p[j] + step * d))
            if EPS < p[j] < 1 - EPS:
                still.append(j)
            else:
                p[j] = round(p[j])
        hand = still
    return np.array(p)


def landing(prob: np.ndarray, size: np.ndarray, rand: np.random.Generator) -> np.ndarray:
    """Settles all units: a flight over all but LAST open ones of all sizes, then the landing problem of what is open.

    The landing takes, of all ways to settle its few units, the one with the least error in words, and of equal ones
    that with the least error in number.
    """
    p = prob.astype(float).copy()
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    open_ = open_[np.argsort(-size[open_], kind="stable")]
    spread = np.unique(np.geomspace(1, len(open_), LAST).astype(int)) - 1 if len(open_) else np.zeros(0, int)
    head, tail = np.delete(open_, spread), open_[spread]
    p[head] = flight(p[head], size[head], rand)
    left = np.concatenate([head[(p[head] > EPS) & (p[head] < 1 - EPS)], tail]).astype(int)
    if len(left):
        ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        words = np.abs((ways - p[left]) @ size[left])
        number = np.abs((ways - p[left]).sum(axis=1))
        p[left] = ways[np.lexsort((number, np.round(words, 6)))[0]]
    return np.round(p)


def _seeded(*key) -> np.random.Generator:
    return np.random.default_rng(xxhash.xxh3_64_intdigest(repr(key).encode()))


def _settle(last: bool, round_no: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "order", "row_id"], ascending=[False, True, True], kind="stable")
        rand = _seeded(round_no, pdf.source_key.iloc[0], int(pdf.block.iloc[0]), int(pdf.part.iloc[0]))
        p = (landing if last else flight)(pdf.prob.to_numpy(float), pdf["size"].to_numpy(float), rand)
        return pd.DataFrame({"row_id": pdf.row_id, "source_key": pdf.source_key, "size": pdf["size"], "order": pdf["order"], "prob": p})

    return run


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(row_id, id, source, size, source_size, target, copies) for every row of docs.

    Only ids, sources and sizes are shuffled.
    """
    src = F.col(source_col).cast("string")
    sized = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), src.alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized, _ = materialize(sized, "sizes")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), weights, share, cap)
    plan = plan.withColumn("rate", F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)).select(F.col("source").alias("s"), F.col("size").alias("source_size"), "n", "target", "rate")
    plan, _ = materialize(plan, "targets")
    largest, round_no = plan.agg(F.max("n")).first()[0] or 0, 0
    plan = few(plan, BROADCAST_ROWS)
    rated = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.floor(F.col("rate") + EPS)
    part = F.greatest(F.col("rate") - whole, F.lit(0.0))
    order = F.xxhash64(F.col("doc_id"), F.col("size"))
    source_key = F.concat(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.lit("s")), F.coalesce("source", F.lit("")))
    still = rated.filter(part > EPS).select("row_id", source_key.alias("source_key"), "size", order.alias("order"), part.alias("prob"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    schema = "row_id bigint, source_key string, size bigint, order bigint, prob double"
    settled: list[DataFrame] = []
    while True:
        last = largest <= LANDING
        blocked = still.withColumn("block", F.pmod(F.xxhash64("order", F.lit(round_no)), F.col("blocks")).cast("int"))
        # rows that share id and size share a block; where they are many it is split
        crowded, _ = materialize(blocked.groupBy("source_key", "block").agg(F.count("*").alias("m")).filter(F.col("m") > 2 * BLOCK), "crowded")
        parts = F.coalesce(F.pmod(F.xxhash64("row_id"), F.ceil(F.col("m") / BLOCK)), F.lit(0)).cast("int")
        blocked = blocked.join(few(crowded, BROADCAST_ROWS), ["source_key", "block"], "left").withColumn("part", parts).drop("m")
        done, _ = materialize(blocked.groupBy("source_key", "block", "part").applyInPandas(_settle(last, round_no), schema), "flight")
        if last:
            settled.append(done.select("row_id", "prob"))
            break
        opened = (F.col("prob") > EPS) & (F.col("prob") < 1 - EPS)
        settled.append(done.filter(~opened).select("row_id", "prob"))
        rest = done.filter(opened)
        counts = rest.groupBy("source_key").agg(F.count("*").alias("m"))
        largest, round_no = (counts.agg(F.max("m")).first()[0] or 0), round_no + 1
        still = rest.join(counts, "source_key").withColumn("blocks", F.ceil(F.col("m") / BLOCK)).drop("m")
    chosen = settled[0]
    for x in settled[1:]:
        chosen = chosen.unionByName(x)
    out = rated.join(chosen, "row_id", "left")
    return out.select("row_id", F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (whole + F.coalesce(F.round("prob"), F.lit(0.0))).cast("int").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row repeated as often as the mix takes it; the columns are those of docs.

    The rows get their number of copies by id and size; rows that repeat both share their copies out among them.
    """
    c = copies(docs, id_col, text_col, source_col)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    key = lambda n: F.struct(F.col(id_col).alias("i"), F.col(source_col).cast("string").alias("s"), n.alias("n")).alias("__sw_key")
    by_key = c.groupBy(key(F.col("size"))).agg(F.sum("copies").alias("__sw_copies"), F.count("*").alias("__sw_rows"))
    by_key, _ = materialize(by_key, "copies")
    keyed, salt = docs.withColumn("__sw_key", key(size)), F.xxhash64(text_col)
    once = by_key.filter("__sw_rows = 1 and __sw_copies > 0").withColumn("__sw_take", F.col("__sw_copies").cast("int"))
    columns = [F.col(c) for c in docs.columns]
    out = spread_join(keyed, once, "__sw_key", "__sw_rows", salt, bound=BROADCAST_ROWS).select(*columns, "__sw_take")
    often = by_key.filter("__sw_rows > 1 and __sw_copies > 0")
    if not often.isEmpty():
        # the odd copies go to the first rows of a key, which are numbered in buckets, without their texts
        again = spread_join(keyed, often.withColumn("__sw_m", F.col("__sw_rows")), "__sw_key", "__sw_rows", salt, bound=BROADCAST_ROWS)
        again, _ = materialize(again.withColumn("__sw_row", F.monotonically_increasing_id()), "repeated")
        bucket = F.pmod(F.xxhash64("__sw_row"), F.ceil(F.col("__sw_m") / ROWS_A_SALT)).cast("int")
        narrow = again.select("__sw_row", "__sw_key", "__sw_copies", "__sw_m", bucket.alias("__sw_bucket"))
        counts = narrow.groupBy("__sw_key", "__sw_bucket").agg(F.count("*").alias("n"))
        before = counts.withColumn("__sw_before", F.sum("n").over(Window.partitionBy("__sw_key").orderBy("__sw_bucket")) - F.col("n")).drop("n")
        at = F.row_number().over(Window.partitionBy("__sw_key", "__sw_bucket").orderBy("__sw_row"))
        ranked = narrow.withColumn("__sw_at", at).join(before, ["__sw_key", "__sw_bucket"])
        per = F.floor(F.col("__sw_copies") / F.col("__sw_m"))
        odd = (F.col("__sw_at") + F.col("__sw_before") <= F.col("__sw_copies") - per * F.col("__sw_m")).cast("int")
        takes = ranked.select("__sw_row", (per + odd).cast("int").alias("__sw_take"))
        out = out.unionByName(again.join(takes, "__sw_row").select(*columns, "__sw_take"))
    return out.filter("__sw_take > 0").withColumn("__sw_copy", F.explode(F.sequence(F.lit(1), F.col("__sw_take")))).select(*columns)
