"""The corpus pipeline: documents in, a sharded training mix out, stage by stage.

Each stage takes what its predecessor kept, as a table read again from Parquet, and its decisions take effect: rejected
documents and near-duplicates go, contaminated ones go, the mix repeats or omits rows, and the last stage says where
each remaining row is stored.

Nulls and odd inputs: every stage takes null, empty, repeated and very long texts, null and repeated ids, null sources
and languages, columns that it does not know, and empty tables, as its operator states. Documents without words (or
with under ten) go in the first stage; rows that repeat id and text count as near-duplicates, of which one stays; an
empty table, or one that a stage empties, gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewell.llm import decontaminate, minhash, mixing, quality_rules, sharding
from sievewell.llm.common import materialize, remove, table
from sievewell.session import prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    return quality_rules.drop_rejected(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    prepare(spark)
    return minhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    prepare(spark)
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    prepare(spark)
    return sharding.shard(docs, keep=["doc_id", "source"])


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("sharding", shards),
]

#: The mix is drawn by a random process that SQL can't express; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, path = materialize(docs, f"stage{i}")
            if before:
                remove(spark, before)
            before = path
    return docs
