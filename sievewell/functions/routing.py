"""Routing as column expressions: privacy, difficulty, path and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from .text import hit_any, hits, mixed_word_count
from .vocabulary import ANALYTICAL, INJECTION, OVERVIEW, REASONING, SENSITIVE, SIMPLE

# USD for a million tokens (in, out). Models that are not listed cost nothing.
PRICES = (("api-large", 5.0, 25.0), ("api-medium", 3.0, 15.0), ("api-small", 1.0, 5.0), ("gateway-medium", 3.0, 15.0))


def difficulty(q: Column) -> Column:
    """Score in [0, 1], rounded to three places. q is lower-cased."""
    r, n = F.size(hits(q, REASONING)), mixed_word_count(q)
    score = (
        F.when(r > 0, F.least(F.lit(0.7), 0.4 + 0.15 * (r - 1))).otherwise(0.0)
        + F.when(n >= 40, 0.3).when(n >= 20, 0.15).otherwise(0.0)
        + F.when(F.length(q) - F.length(F.translate(q, "?", "")) >= 2, 0.15).otherwise(0.0)
        - F.when((F.size(hits(q, SIMPLE)) > 0) & (n < 20) & (r == 0), 0.3).otherwise(0.0)
    )
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 3)


def injection_pattern(q: Column) -> Column:
    """The first pattern that the question matches, else null."""
    out = F
    for p in INJECTION:
        out = out.when(q.rlike("(?iu)" + p), F.lit(p))
    return out


def with_route(df: DataFrame, query_col: str = "query", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Adds sensitive_hits, difficulty, route, model and router_reason. Sensitive questions stay local, whatever their difficulty."""
    q = F.lower(F.coalesce(query_col, F.lit("")))
    out = df.withColumn("sensitive_hits", hits(q, SENSITIVE)).withColumn("difficulty", difficulty(q))
    private, hard = F.size("sensitive_hits") > 0, F.col("difficulty") >= settings.hard_threshold
    to_api = ~private & hard & F.lit(settings.api_available)
    return (
        out.withColumn("route", F.when(to_api, "api").otherwise("local"))
        .withColumn("model", F.when(to_api, settings.api_model).otherwise(settings.local_model))
        .withColumn("router_reason", F.when(private, F.concat(F.lit("sensitive: "), F.array_join("sensitive_hits", ", "))).when(hard, "hard").otherwise("easy"))
    )


def with_path(df: DataFrame, query_col: str = "query", settings: Settings = Settings(), sql_ready: bool = True, graph_ready: bool = True, forced: str = "auto") -> DataFrame:  # noqa: B008
    """Adds path: blocked, sql, graph or hybrid. ``forced``: auto, sql, graph, hybrid, local or api."""
    if forced == "sql" and not sql_ready:
        raise ValueError("the SQL path is not available")
    if forced == "graph" and not graph_ready:
        raise ValueError("the graph path is not available")
    q = F.coalesce(F.col(query_col), F.lit(""))
    path = F.when(injection_pattern(q).isNotNull(), "blocked")
    if forced == "sql" or forced == "auto" and settings.sql_enabled and sql_ready:
        path = path.when(F.lit(forced == "sql") | hit_any(q, ANALYTICAL), "sql")
    if forced == "graph" or forced == "auto" and settings.graph_enabled and graph_ready:
        path = path.when(F.lit(forced == "graph") | hit_any(q, OVERVIEW), "graph")
    return df.withColumn("path", path.otherwise("hybrid"))


def price_table(spark: SparkSession, prices=PRICES) -> DataFrame:
    return spark.createDataFrame([*prices], "model string, usd_in double, usd_out double")


def with_cost(df: DataFrame, prices: DataFrame, model_col: str = "model", in_col: str = "input_tokens", out_col: str = "output_tokens", name: str = "cost_usd") -> DataFrame:
    """Adds the cost in USD; unknown models cost nothing. The price table has a row for each model and is broadcast."""
    p = F.broadcast(prices.select(F.col("model").alias("__model"), F.col("usd_in").alias("__in"), F.col("usd_out").alias("__out")))
    cost = F.col(in_col) / 1e6 * F.coalesce("__in", F.lit(0.0)) + F.col(out_col) / 1e6 * F.coalesce("__out", F.lit(0.0))
    return df.join(p, F.col(model_col) == F.col("__model"), "left").withColumn(name, cost).drop("__model", "__in", "__out")
