"""Bounded, class-balanced samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unit_hash


def sample_labels(labels: DataFrame, label_col: str, learn: Column, bound: int, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """(id, label) of about ``bound`` labelled documents, half of each class as far as there are so many; class sizes.

    ``learn`` says which labels may be learned from. A hash of the id decides, so the sample is the same in any run.
    A document with contradicting labels counts as of the larger one.
    """
    rows = labels.filter(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__sw_id")).agg(F.max(label_col).alias("label"))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    fewest = min(sizes.values(), default=0)
    want = {y: min(n, max(bound // 2, bound - fewest)) for y, n in sizes.items()}
    chance = F.lit(0.0)
    for y, n in sizes.items():
        chance = F.when(F.col("label") == y, want[y] / n).otherwise(chance)
    return rows.filter(unit_hash(F.col("__sw_id")) < chance), sizes


def sampled(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, label, text) of the sampled documents, one text for each id (that of the least hash).

    The sample is bounded, so it is broadcast; only texts of the sample are shuffled, one for each id and task.
    """
    rows = docs.select(F.col(id_col).alias("__sw_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "__sw_id")
    return rows.groupBy("__sw_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
