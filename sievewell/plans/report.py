"""Cost and routing reports over a query log, and their rendering."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.routing import with_cost


def route_summary(log: DataFrame, prices: DataFrame, api_model: str) -> DataFrame:
    """One row: counts and shares by route, cost, what the API alone would have cost, savings, latency by route. Zeros for no rows."""
    priced = with_cost(log.withColumn("__api", F.lit(api_model)), prices, "__api", name="__all_api")
    n, local, api = F.count("*"), F.count_if(F.col("route") == "local"), F.count_if(F.col("route") == "api")
    cost, base = F.coalesce(F.sum("cost_usd"), F.lit(0.0)), F.coalesce(F.sum("__all_api"), F.lit(0.0))
    share = lambda x: F.round(F.when(n > 0, 100.0 * x / F.when(n > 0, n)).otherwise(0.0), 4)
    ms = lambda r: F.round(F.coalesce(F.avg(F.when(F.col("route") == r, F.col("latency_ms"))), F.lit(0.0)), 4)
    return priced.agg(
        n.alias("n"), local.alias("local"), api.alias("api"), share(local).alias("local_pct"), share(api).alias("api_pct"),
        F.round(cost, 6).alias("cost"), F.round(base, 6).alias("baseline_cost"), F.round(base - cost, 6).alias("saved"),
        F.round(F.when(base > 0, 100.0 * (base - cost) / F.when(base > 0, base)).otherwise(0.0), 4).alias("saved_pct"),
        ms("local").alias("local_ms"), ms("api").alias("api_ms"),
    )


def markdown(rows: list[dict], columns: list[str] | None = None) -> str:
    columns = columns or list(rows[0]) if rows else columns or []
    line = lambda xs: "| " + " | ".join("" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x) for x in xs) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *(line([r.get(c) for c in columns]) for r in rows)])


def save(folder: str, name: str, rows: list[dict], title: str = "") -> tuple[str, str]:
    """Writes a Markdown and a JSON report with the time in their names."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    stem = at / f"{name}-{time.strftime('%Y%m%dT%H%M%SZ', time.gmtime())}"
    stem.with_suffix(".md").write_text(f"# {title or name}\n\n{markdown(rows)}\n")
    stem.with_suffix(".json").write_text(json.dumps(rows, indent=1, default=str))
    return str(stem.with_suffix(".md")), str(stem.with_suffix(".json"))


def simulate(questions: DataFrame, prices: DataFrame, settings, query_col: str = "query", context_tokens: int = 800, answer_tokens: int = 180) -> DataFrame:
    """Questions with route, model, assumed tokens (1.3 a word and the context; a fixed answer) and cost."""
    from ..functions.routing import with_route
    from ..functions.text import words

    out = with_route(questions, query_col, settings)
    out = out.withColumn("input_tokens", (F.lit(context_tokens) + F.floor(F.size(words(F.col(query_col))) * 1.3)).cast("bigint")).withColumn("output_tokens", F.lit(answer_tokens).cast("bigint"))
    return with_cost(out, prices)


# --- marts over the log (extensions) ----------------------------------------------------------------------------


def cost_daily(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 6).alias("cost"))


def route_split(log: DataFrame) -> DataFrame:
    return log.filter("route is not null").groupBy(F.to_date("created_at").alias("day"), "route").agg(F.count("*").alias("n"))


def latency_by_route(log: DataFrame) -> DataFrame:
    p = lambda x: F.round(F.percentile("latency_ms", F.lit(x)), 4)
    return log.filter("route is not null").groupBy("route").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.count("*").alias("n"))


def eval_trend(runs: DataFrame) -> DataFrame:
    """(config, metric, day, n, value, change): the mean of each metric of a configuration by day, and the change since its last day with runs.

    runs: config, metric, day, value. Days are aggregated first, so the window of a configuration has a row a day.
    """
    daily = runs.groupBy("config", "metric", "day").agg(F.count("value").alias("n"), F.avg("value").alias("value"))
    before = F.lag("value").over(Window.partitionBy("config", "metric").orderBy("day"))
    return daily.select("config", "metric", "day", "n", F.round("value", 6).alias("value"), F.round(F.col("value") - before, 6).alias("change"))


def broken_rules(df: DataFrame, key: str, not_null: list[str] = (), accepted: dict[str, list] | None = None, relationships: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(rule, n) of data tests that fail: nulls, repeated keys, values that are not accepted, values that a parent table's column lacks."""
    checks = {f"not_null:{c}": F.count_if(F.col(c).isNull()) for c in not_null} | {f"accepted:{c}": F.count_if(~F.col(c).isin(*v)) for c, v in (accepted or {}).items()}
    checks[f"unique:{key}"] = F.count(key) - F.countDistinct(key)
    row = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks.values())])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"c{i}").alias("n")) for i, k in enumerate(checks)]))
    out = row.select(pairs.alias("x")).select("x.*")
    for c, (parent, its) in (relationships or {}).items():  # counted by value first, so a frequent value is one row of the join
        values = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("__value")).agg(F.count("*").alias("__n"))
        orphans = values.join(parent.select(F.col(its).alias("__value")).distinct(), "__value", "left_anti")
        out = out.unionByName(orphans.agg(F.lit(f"relationships:{c}").alias("rule"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n")))
    return out.filter("n > 0")
