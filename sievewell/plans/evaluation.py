"""Evaluation runs: judged answers, configurations of retrieval, SQL answers, overview questions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import judge_score
from ..functions.routing import with_cost
from ..operators import metrics
from ..operators.graph import ensure_checkpoint_dir
from ..operators.retrieval import context
from . import clients, report, schema, sql_gate
from .engine import Engine

Factory = Callable[[str], clients.Client]


def judge(answers: DataFrame, factory: Factory, route: str = "local") -> DataFrame:
    """(qid, faithfulness, relevancy) of answers (qid, query, answer, context): two calls a row, in the tasks; a reply without a number is 0."""
    kind = answers.schema["qid"].dataType.simpleString()

    def run(batches):
        client = None
        for pdf in batches:
            if len(pdf) and client is None:
                client = factory(route)
            out = {"qid": pdf.qid}
            for what in ("faithfulness", "relevancy"):
                out[what] = pd.Series([client.chat(clients.judge_messages(what, *r)).text for r in zip(pdf["query"], pdf.answer, pdf.context, strict=True)], index=pdf.index, dtype=object)
            yield pd.DataFrame(out)

    filled = answers.select("qid", *[F.coalesce(c, F.lit("")).alias(c) for c in ("query", "answer", "context")])
    replies = filled.mapInPandas(run, f"qid {kind}, faithfulness string, relevancy string")
    return replies.select("qid", *[judge_score(F.coalesce(c, F.lit(""))).alias(c) for c in ("faithfulness", "relevancy")])


def judged_means(judged: DataFrame) -> dict[str, float | None]:
    """Means over all answers; None without any."""
    return judged.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("faithfulness", "relevancy")]).first().asDict()


def configurations(settings, rerank_with: str = "llm") -> dict:
    """The compared settings by name."""
    return {
        "vector-only": replace(settings, mode="vector", reranker="none"),
        "hybrid": replace(settings, mode="hybrid", reranker="none"),
        "hybrid+rerank": replace(settings, mode="hybrid", reranker=rerank_with),
    }


def run_eval(engine: Engine, items: DataFrame, k: int = 5, judges: Factory | None = None, rerank_with: str = "llm", configs: dict | None = None) -> list[dict]:
    """A row for each configuration over items (question, relevant_doc_ids): recall, mrr and hit over the labelled ones, latency of
    retrieval alone, and, with judges, mean faithfulness and relevancy of the answers to all items."""
    ensure_checkpoint_dir(items)
    asked = items.select(F.xxhash64("question").alias("qid"), F.col("question").alias("query"), F.col("relevant_doc_ids").alias("relevant")).dropDuplicates(["qid"]).checkpoint()
    n, out = asked.count(), []
    for name, s in (configs or configurations(engine.settings, rerank_with)).items():
        began = time.monotonic()
        found = engine.retrieve(asked.select("qid", "query"), replace(s, top_k_final=k)).checkpoint()
        latency = 1000 * (time.monotonic() - began) / max(1, n)
        lists = found.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]).alias("retrieved"))
        scored = metrics.per_query(asked.join(lists, "qid", "left").withColumn("retrieved", F.coalesce("retrieved", F.expr("array()").cast("array<string>"))), k)
        row = {"config": name} | metrics.summary(scored).first().asDict() | {"latency_ms": latency}
        if judges is not None:
            row |= judged_means(judge(_answered(engine, asked, found), judges))
        out.append(row)
    return out


def _answered(engine: Engine, asked: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, query, answer, context): answers of the local model from what was found; the judge sees the texts without their numbers."""
    texts = found.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n\n").alias("texts"))
    rows = asked.select("qid", "query", F.lit("local").alias("route")).join(context(found), "qid", "left")
    return engine.chat(rows).select("qid", "query", "answer").join(texts, "qid", "left").withColumnRenamed("texts", "context")


def sql_runs(engine: Engine, items: Iterable[tuple[str, str]], route: str = "local") -> DataFrame:
    """(question, ok, error, latency_ms, tokens, tables, all_tables) of items (question, reference statement).

    A statement is right if its rows are those of the reference, in any order and with numbers nearly equal. Each needs a Spark query
    of its own, so items are a short stated set on the driver; rows are limited on both sides.
    """
    spark, s, rows = engine.spark, engine.settings, []
    for question, reference in items:
        sql_gate.check(spark, reference)
        wanted = [tuple(r) for r in spark.sql(reference).limit(s.sql_max_rows + 1).collect()]
        client, began = engine.factory(route), time.monotonic()
        names = schema.narrow(spark, question, s.schema_top_k, client.embed, engine.tables)
        reply = client.chat(clients.sql_messages(question, schema.describe(spark, names)))
        done = sql_gate.run(spark, reply.text, s)
        latency = 1000 * (time.monotonic() - began)
        ok = done.ok and metrics.rows_match(wanted, done.rows)
        rows.append((question, ok, done.error, latency, reply.input_tokens + reply.output_tokens, len(names), len(engine.tables or [])))
    return spark.createDataFrame(rows, "question string, ok boolean, error string, latency_ms double, tokens bigint, tables int, all_tables int")


def execution_summary(runs: DataFrame) -> DataFrame:
    """One row: n, accuracy, mean, med and p95 of the latency, tokens, tables, and trips, the statements that a guard has stopped. Zeros for no rows."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return runs.agg(
        F.count("*").alias("n"), F.round(F.coalesce(F.avg(F.col("ok").cast("double")), F.lit(0.0)), 6).alias("accuracy"), mean("latency_ms").alias("mean"),
        F.round(metrics.percentile("latency_ms", 0.5), 4).alias("med"), F.round(metrics.percentile("latency_ms", 0.95), 4).alias("p95"),
        mean("tokens").alias("tokens"), mean("tables").alias("tables"), F.count_if(F.coalesce(F.contains("error", F.lit("exceeded")), F.lit(False))).alias("trips"),
    )


def sql_eval(engine: Engine, items: Iterable[tuple[str, str]], route: str = "local") -> dict:
    return execution_summary(sql_runs(engine, items, route)).first().asDict()


def overview_runs(engine: Engine, items: DataFrame, judges: Factory | None = None) -> DataFrame:
    """(approach, faithfulness, relevancy, tokens, cost_usd, latency_ms) of each item (question), answered from chunks and from communities."""
    ensure_checkpoint_dir(items)
    asked, out = items.select(F.xxhash64("question").alias("qid"), F.col("question").alias("query")).dropDuplicates(["qid"]), None
    for path in ("hybrid", "graph"):
        done = engine.answers_by(asked, path).checkpoint()
        priced = with_cost(done, engine.prices).select("qid", F.lit(path).alias("approach"), (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), "cost_usd", "latency_ms")
        if judges is None:
            rows = priced.withColumns({c: F.lit(None).cast("double") for c in ("faithfulness", "relevancy")})
        else:
            snippets = F.array_join(F.transform("citations", lambda x: x["snippet"]), "\n\n")
            rows = priced.join(judge(done.select("qid", "query", "answer", snippets.alias("context")), judges), "qid")
        rows = rows.select("approach", "faithfulness", "relevancy", "tokens", "cost_usd", "latency_ms")
        out = rows if out is None else out.unionByName(rows)
    return out


def approach_summary(runs: DataFrame) -> DataFrame:
    """A row for each approach: means over its answers; those of judges over the answers that they have judged, null without any."""
    return runs.groupBy("approach").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("faithfulness", "relevancy", "tokens", "cost_usd", "latency_ms")])


def overview_eval(engine: Engine, items: DataFrame, judges: Factory | None = None) -> list[dict]:
    return [r.asDict() for r in approach_summary(overview_runs(engine, items, judges)).orderBy(F.desc("approach")).collect()]


def save(folder: str, name: str, rows: list[dict], meta: dict) -> tuple[str, str]:
    """Writes the report of a run, as Markdown and JSON, with what it was made with."""
    return report.save(folder, name, [r | meta for r in rows], f"{name}: {', '.join(f'{k} {v}' for k, v in meta.items())}")
