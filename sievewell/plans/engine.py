"""The question-answering engine: a table of questions in, a table of answers out."""

from __future__ import annotations

import functools
import itertools
import threading
import time
import warnings
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import parse
from ..functions.routing import PRICES, price_table, with_cost, with_path, with_route
from ..functions.text import snippet
from ..functions.vocabulary import NO_ANSWER, SUFFIXES
from ..operators import graph
from ..operators.retrieval import context, hybrid, if_few, relevance_floor, rerank
from ..session import missing
from ..sources import documents, store
from . import clients, rerankers, schema, sql_gate

Factory = Callable[[str], clients.Client]
#: Answers of the SQL and graph paths that the driver holds at once.
SQL_QUESTIONS = 1000
#: Questions of these paths that are answered at the same time.
AT_ONCE = 4


class Engine:
    """Answers batches of questions over a corpus, registered tables and an entity graph.

    ``factory(route)`` makes a client for ``local`` or ``api``; it is called inside the tasks. Rerankers are made by
    ``reranker_builder``, or as rerankers.apply does; ``scorer(queries, texts)`` takes the place of a cross-encoder.
    """

    def __init__(self, spark: SparkSession, settings: Settings, factory: Factory, corpus: store.Corpus, log_path: str | None = None, graphs: store.GraphStore | None = None, tables: list[str] | None = None, prices=PRICES, scorer=None, reranker_builder=None):
        self.spark, self.settings, self.factory, self.corpus = spark, settings, factory, corpus
        if lacks := missing(spark):
            warnings.warn(f"the session lacks settings that the engine relies on, see sievewell.session: {lacks}", stacklevel=2)
        self.log_path, self.graphs, self.tables, self.scorer = log_path, graphs, tables, scorer
        self._mine = threading.local()
        self.prices, self.reranker_builder = price_table(spark, prices), reranker_builder

    # --- documents ---

    def ingest(self, docs: DataFrame) -> dict[str, int]:
        return self.corpus.ingest(docs, self.settings, lambda xs, f=self.factory: f("local").embed(xs))

    def ingest_directory(self, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> dict[str, int]:
        """Files below a folder; a file's source is its path below the folder, so files of one name stay apart."""
        return self.ingest(documents.read_directory(self.spark, folder, suffixes).withColumn("source", F.col("path")))

    def ingest_sql(self, query: str, id_col: str | None = None, prefix: str = "sql", order: list[str] | None = None, max_rows: int | None = 100_000) -> dict[str, int]:
        """Rows of a read-only query, each a document; see sources.documents.sql_documents."""
        return self.ingest(documents.sql_documents(self.spark, query, id_col, prefix, order, max_rows))

    def sources(self) -> DataFrame:
        return self.corpus.sources()

    def delete(self, source: str) -> int:
        """Removes a source; communities that lose all their sources go too."""
        n = self.corpus.delete(source)
        if n and self.graphs and self.graphs.exists():
            t = self.graphs.tables["communities"]
            t.replace(graph.rebuild(t.read(), self.corpus.chunks()))
        return n

    # --- questions ---

    def retrieve(self, questions: DataFrame, settings: Settings | None = None) -> DataFrame:
        """(qid, query, id, source, chunk_index, content, score, rank) for questions (qid, query)."""
        s = settings or self.settings
        factory = self.factory

        def embed(batches):
            c = factory("local")
            for pdf in batches:
                yield pdf.assign(embedding=[[float(x) for x in v] for v in c.embed(list(pdf["query"]))] if len(pdf) else [])

        kind = questions.schema["qid"].dataType.simpleString()
        asked = questions.select("qid", "query").mapInPandas(embed, f"qid {kind}, query string, embedding array<double>")
        chunks = self.corpus.chunks()
        fuses = s.mode == "hybrid" and s.reranker != "none"
        wide = replace(s, top_k_final=s.top_k_vector + s.top_k_keyword) if fuses else s  # all that either leg found
        found = hybrid(chunks, chunks, asked, wide).join(chunks.select("id", "source", "chunk_index", "content"), "id").join(if_few(questions.select("qid", "query"), questions), "qid")
        calibrated = fuses and s.reranker in ("local", "hosted")
        if fuses:
            ranked = rerank(found, self.scorer, s.top_k_final) if self.scorer and s.reranker == "local" else rerankers.apply(found, s, factory, self.reranker_builder)
            found = ranked.join(found.drop("score", "rank"), ["qid", "id"])
        return relevance_floor(found, s.relevance_floor, calibrated)

    def ask(self, questions: DataFrame, forced: str = "auto", mode: str | None = None, top_k: int | None = None, reranked: bool = False) -> DataFrame:
        """Answers questions (qid, query): path, route, answer, citations, tokens, cost and latency; logged if there is a log.

        ``reranked`` asks for the reranker of the settings for this batch, or the listwise one where they name none.
        """
        if top_k is not None and not 1 <= top_k <= 50:
            raise ValueError("top_k must be from 1 to 50")
        s = replace(self.settings, mode=mode or self.settings.mode, top_k_final=top_k or self.settings.top_k_final)
        if reranked and s.reranker == "none":
            s = replace(s, reranker="llm")
        graph_ready = self.graphs is not None and self.graphs.exists()
        routed = with_path(with_route(questions.filter("length(query) > 0"), "query", s), "query", s, bool(self.tables), graph_ready, forced)
        if forced == "local":
            routed = routed.withColumn("route", F.lit("local")).withColumn("model", F.lit(s.local_model))
        elif forced == "api" and s.api_available:  # privacy still wins
            private = F.size("sensitive_hits") > 0
            routed = routed.withColumn("route", F.when(private, "local").otherwise("api")).withColumn("model", F.when(private, s.local_model).otherwise(s.api_model))
        parts = [self._blocked(routed.filter("path = 'blocked'")), self._hybrid(routed.filter("path = 'hybrid'"), s)]
        if self.tables:
            parts.append(self._sql(routed.filter("path = 'sql'"), s))
        if graph_ready:
            parts.append(self._graph(routed.filter("path = 'graph'")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = with_cost(out, self.prices)
        if self.log_path:
            log = out.select(F.xxhash64("qid", "query", F.current_timestamp()).alias("id"), "query", "answer", F.size("citations").alias("num_citations"), "latency_ms", F.current_timestamp().alias("created_at"), "route", "model", "input_tokens", "output_tokens", "cost_usd", "router_reason", "difficulty")
            store.append_log(log, self.log_path)
        return out

    _OUT = ("qid", "query", "path", "route", "model", "router_reason", "difficulty", "answer", "citations", "input_tokens", "output_tokens", "latency_ms", "answered")
    _CITATION = "array<struct<n:int,source:string,chunk_index:int,score:double,snippet:string>>"

    def _blocked(self, q: DataFrame) -> DataFrame:
        return q.withColumns({"answer": F.lit("The question was refused."), "citations": F.expr("array()").cast(self._CITATION), "input_tokens": F.lit(0).cast("bigint"), "output_tokens": F.lit(0).cast("bigint"), "latency_ms": F.lit(0).cast("bigint"), "answered": F.lit(False)}).select(*self._OUT)

    def _hybrid(self, q: DataFrame, s: Settings) -> DataFrame:
        found = self.retrieve(q, s)
        cited = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("int").alias("n"), "source", "chunk_index", F.col("score").cast("double").alias("score"), snippet(F.col("content")).alias("snippet")))).alias("citations"))
        asked = q.join(context(found), "qid", "left").join(cited, "qid", "left").withColumn("citations", F.coalesce("citations", F.expr("array()").cast(self._CITATION)))
        return self._chat(asked, lambda r: clients.answer_messages(r["query"], r["context"]) if r["context"] else None)

    def _chat(self, asked: DataFrame, messages) -> DataFrame:
        answered = (F.size("citations") > 0) & ~F.startswith("answer", F.lit(NO_ANSWER))
        return self._call(asked, messages).withColumn("answered", answered).select(*self._OUT)

    def _call(self, asked: DataFrame, messages) -> DataFrame:
        """One call for each row; rows without messages get the no-answer sentence and no call."""
        factory = self.factory
        keep = [c for c in self._OUT if c in asked.columns]
        kinds = ", ".join(f"{c} {asked.schema[c].dataType.simpleString()}" for c in keep)

        def run(batches):
            client = functools.cache(factory)
            for pdf in batches:
                rows = []
                for r in pdf.to_dict("records"):
                    began = time.monotonic()
                    m = messages(r)
                    reply = clients.Reply(NO_ANSWER) if m is None else client(r["route"]).chat(m)
                    rows.append({c: r[c] for c in keep} | {"answer": reply.text, "input_tokens": reply.input_tokens, "output_tokens": reply.output_tokens, "latency_ms": int(1000 * (time.monotonic() - began))})
                yield pd.DataFrame(rows, columns=[*keep, "answer", "input_tokens", "output_tokens", "latency_ms"])

        return asked.mapInPandas(run, f"{kinds}, answer string, input_tokens bigint, output_tokens bigint, latency_ms bigint")

    def chat(self, asked: DataFrame) -> DataFrame:
        """asked (qid, query, route, context) with answer, tokens and latency."""
        return self._call(asked, lambda r: clients.answer_messages(r["query"], r["context"]) if r["context"] else None)

    def answers_by(self, questions: DataFrame, path: str, route: str = "local", settings: Settings | None = None) -> DataFrame:
        """Answers of one path, hybrid or graph, to questions (qid, query), whatever these are about; not logged."""
        s = settings or self.settings
        model = s.api_model if route == "api" else s.local_model
        q = with_route(questions, "query", s).withColumns({"path": F.lit(path), "route": F.lit(route), "model": F.lit(model)})
        return self._hybrid(q, s) if path == "hybrid" else self._graph(q)

    def _sql(self, q: DataFrame, s: Settings) -> DataFrame:
        """Each question needs a statement of its own, which only the driver can start."""

        def answer(r):
            began = time.monotonic()
            client = self._client(r.route)
            names = schema.narrow(self.spark, r["query"], s.schema_top_k, client.embed, self.tables)
            first = client.chat(clients.sql_messages(r["query"], schema.describe(self.spark, names)))
            done = sql_gate.run(self.spark, first.text, s)
            answer, cites, tokens = NO_ANSWER, [], (first.input_tokens, first.output_tokens)
            if done.ok:
                second = client.chat(clients.sql_answer_messages(r["query"], done.sql, sql_gate.render(done.columns, done.rows)))
                answer = second.text
                cites = [(1, "sql", 0, 1.0, f"{done.sql}\n{sql_gate.render(done.columns, done.rows, 5)}"[:400])]
                tokens = (tokens[0] + second.input_tokens, tokens[1] + second.output_tokens)
            return r.qid, r["query"], "sql", r.route, r.model, r.router_reason, r.difficulty, answer, cites, *tokens, int(1000 * (time.monotonic() - began)), done.ok

        return self._one_by_one(q, answer)

    def _graph(self, q: DataFrame) -> DataFrame:
        """Map over the communities, reduce over what they say; at most eight communities a question."""
        graph.ensure_checkpoint_dir(q)
        comms = graph.rebuild(self.graphs.load()["communities"], self.corpus.chunks()).checkpoint()  # live ones, with their live sources
        embedded = comms.filter(F.coalesce(F.size("embedding"), F.lit(0)) > 0)
        chosen = graph.select_by_size(comms) if embedded.isEmpty() else None

        def answer(r):
            began = time.monotonic()
            client = self._client(r.route)
            best = (chosen if chosen is not None else graph.rank_communities(comms, [float(x) for x in client.embed([r["query"]])[0]])).collect()
            answer, cites, tokens = global_answer(client, r["query"], best, set())
            return r.qid, r["query"], "graph", r.route, r.model, r.router_reason, r.difficulty, answer, cites, *tokens, int(1000 * (time.monotonic() - began)), bool(cites)

        return self._one_by_one(q, answer)

    def _client(self, route: str) -> clients.Client:
        """The client of a route in this thread of the driver."""
        mine = self._mine.__dict__
        if route not in mine:
            mine[route] = self.factory(route)
        return mine[route]

    def _one_by_one(self, q: DataFrame, answer: Callable) -> DataFrame:
        """The rows that ``answer`` makes of all questions, a few at a time, on the driver; full blocks of them go to the shared folder."""
        kinds = f"qid {q.schema['qid'].dataType.simpleString()}, query string, path string, route string, model string, router_reason string, difficulty double, answer string, citations {self._CITATION}, input_tokens bigint, output_tokens bigint, latency_ms bigint, answered boolean"
        blocks, rows, asked = [], [], q.toLocalIterator()
        with ThreadPoolExecutor(AT_ONCE) as pool:  # a thread's jobs carry tags of its own
            while taken := list(itertools.islice(asked, AT_ONCE)):
                rows += pool.map(answer, taken)
                if len(rows) >= SQL_QUESTIONS:
                    graph.ensure_checkpoint_dir(q)
                    blocks.append(self.spark.createDataFrame(rows, kinds).checkpoint())
                    rows = []
        out = self.spark.createDataFrame(rows, kinds)
        for b in blocks:
            out = out.unionByName(b)
        return out

    def history(self, n: int = 20) -> DataFrame:
        if not self.log_path:
            raise ValueError("there is no log")
        return store.recent(store.read_log(self.spark, self.log_path), n)


def parse_map_reply(reply: str) -> tuple[int, str]:
    """Score and points of a map reply, by the rules of functions.parse.map_score."""
    import re

    m = re.search(r"points:(.*)$", reply, re.IGNORECASE | re.DOTALL)
    points = (m[1] if m else reply).strip()
    given = re.search(parse.SCORE, reply)
    return (min(100, int(given[1])) if given else 0 if points.lower() in parse.NOTHING else 50), points


def global_answer(client, query: str, comms: list, live: set[str]) -> tuple[str, list, tuple[int, int]]:
    """(answer, citations, tokens) from communities: those with a score and points, the best first."""
    kept, used = [], [0, 0]
    for c in comms:
        reply = client.chat(clients.map_messages(query, c["summary"]))
        used = [used[0] + reply.input_tokens, used[1] + reply.output_tokens]
        score, points = parse_map_reply(reply.text)
        if score > 0 and points.lower() not in parse.NOTHING:
            kept.append((score, points, c))
    kept.sort(key=lambda x: -x[0])
    if not kept:
        return NO_ANSWER, [], tuple(used)
    final = client.chat(clients.reduce_messages(query, "\n".join(f"- ({s}) {p}" for s, p, _ in kept)))
    cites = [(i, ", ".join(x for x in c["sources"] if not live or x in live), 0, float(s), p if len(p) <= 240 else p[:240] + "…") for i, (s, p, c) in enumerate(kept, 1)]
    return final.text, cites, (used[0] + final.input_tokens, used[1] + final.output_tokens)


def build_graph(chunks: DataFrame, factory: Factory, graphs: store.GraphStore, method: str = "modularity") -> dict[str, int]:
    """Extracts entities and relationships from chunks, finds communities (see graph.communities), summarises them and stores all."""

    def ask(batches):
        c = factory("local")
        for pdf in batches:
            yield pd.DataFrame({"id": pdf.id, "reply": [c.chat(clients.extract_messages(t)).text for t in pdf.content]})


    graph.ensure_checkpoint_dir(chunks)
    replies = chunks.select("id", "content").mapInPandas(ask, "id bigint, reply string").checkpoint()
    lines = parse.extraction_lines(replies, "id", "reply")
    found = parse.entities(lines, "id").withColumn("chunk_id", F.col("id")).withColumn("ord", F.col("id").cast("decimal(38,0)") * 10000 + F.col("line_no"))
    merged = graph.merge_entities(found, "ord").checkpoint()
    rel = graph.valid_edges(parse.relationships(lines, "id"), merged).checkpoint()
    comms = graph.communities(rel.select(F.col("s").alias("a"), F.col("t").alias("b")), method)
    sources = graph.provenance(comms, merged, chunks)
    sizes = comms.groupBy("community").agg(F.count("*").alias("n"))
    big = sizes.filter("n >= 2")
    use = sizes if big.isEmpty() else big
    facts = community_facts(comms, merged, rel)

    def summarise(batches):
        c = factory("local")
        for pdf in batches:
            yield pdf.assign(summary=[c.chat([{"role": "user", "content": f"Summarise:\n{f}"}]).text.strip() for f in pdf.facts])

    summed = facts.join(use.select("community"), "community").mapInPandas(summarise, "community int, entity_names array<string>, facts string, summary string")
    table = summed.join(sources, "community", "left").select(F.col("community").alias("id"), "summary", "entity_names", F.coalesce("sources", F.expr("array()").cast("array<string>")).alias("sources"), F.lit(None).cast("array<double>").alias("embedding"))
    graphs.save(merged, rel.select("source", "target", "description"), table, lambda xs, f=factory: f("local").embed(xs))
    loaded = graphs.load()
    return {"entities": loaded["entities"].count(), "relationships": loaded["relationships"].count(), "communities": loaded["communities"].count()}


def community_facts(comms: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, entity_names, facts): what a summary is made from: the members, and the relationships whose two ends are both members.

    comms: community, id; entities: key, name, type, description; edges: s, t (keys), source, target, description.
    """
    own = comms.join(entities, F.col("id") == F.col("key"))
    members = own.groupBy("community").agg(
        F.array_sort(F.collect_list("name")).alias("entity_names"),
        F.array_join(F.array_sort(F.collect_list(F.format_string("- %s (%s): %s", "name", "type", "description"))), "\n").alias("members"),
    )
    left, right = comms.select("community", F.col("id").alias("s")), comms.select(F.col("community").alias("other"), F.col("id").alias("t"))
    inside = edges.join(left, "s").join(right, "t").filter("community = other")
    links = inside.groupBy("community").agg(F.array_join(F.array_sort(F.collect_set(F.format_string("- %s → %s: %s", "source", "target", "description"))), "\n").alias("links"))
    joined = members.join(links, "community", "left")
    facts = F.concat(F.lit("Entities:\n"), "members", F.lit("\nRelationships:\n"), F.coalesce("links", F.lit("(none)")))
    return joined.select("community", "entity_names", facts.alias("facts"))


def estimate_build(n_chunks: int, communities: int = 5) -> int:
    """Model calls that a build takes, about."""
    return n_chunks + communities
