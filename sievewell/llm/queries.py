"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, forest, language, lexical, minhash, mixing, quality_classifier, quality_rules, sharding, toxicity, trie, url_filter, warc
from .common import doc_crc, table
from .oracles import ORACLE_SQL  # noqa: F401

# Fixed values of the URL filter's query.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, URL_RULES)
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_crc(F.col("doc_id")) % 4 == 2
    return language.identify(table(spark, sf_dir, "documents"), ~held_out, keep={"doc_id": F.col("doc_id"), "held_out": held_out})


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_crc(F.col("doc_id")) % 5 == 0
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out, keep={"doc_id": F.col("doc_id"), "held_out": held_out})
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = mixing.copies(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = doc_crc(F.col("doc_id")) % 5 == 0
    out = quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out, keep={"doc_id": F.col("doc_id"), "held_out": held_out})
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.build(table(spark, sf_dir, "conversations"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_lexical_search": op11_lexical_search,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_embedding_dedup": op13_embedding_dedup,
}


