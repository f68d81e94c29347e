"""Rerankers by setting: a cross-encoder, a hosted service, or a language model that orders a list.

A reranker is made where it runs, once in a Python worker for each set of settings that define it, however many tasks
and queries that worker serves. Settings travel to the tasks; models, connections and keys don't.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.parse import rank_list
from ..operators.retrieval import rerank
from . import clients

#: Replies of a service that may be followed by a better one.
RETRIED = (408, 429, 500, 502, 503, 504)
#: A listwise model sees so many candidates of a question, and so many characters of each.
SHOWN, CHARS = 12, 300


class Key(NamedTuple):
    """The settings that define a reranker."""

    kind: str
    model: str
    url: str
    key_name: str


class Pairs(Protocol):
    """Scores pairs of a question and a text, of any questions."""

    def scores(self, queries: list[str], texts: list[str]) -> list[float]: ...


class CrossEncoder:
    """A local model; needs sentence-transformers."""

    def __init__(self, key: Key):
        try:
            from sentence_transformers import CrossEncoder as Model
        except ImportError as e:
            raise ImportError("reranker 'local' needs sentence-transformers") from e
        self.model = Model(key.model)

    def scores(self, queries: list[str], texts: list[str]) -> list[float]:
        return [float(x) for x in self.model.predict(list(zip(queries, texts, strict=True)))]


class Hosted:
    """A service that takes {model, query, documents, top_n} and answers {results: [{index, relevance_score}]}.

    The key is read from the environment of the workers, by name. A text that the service leaves out has no score.
    """

    def __init__(self, key: Key, attempts: int = 4, wait: float = 0.5, timeout: float = 30.0):
        if not key.url:
            raise ValueError("reranker 'hosted' needs reranker_url")
        if key.key_name and not os.environ.get(key.key_name):
            raise ValueError(f"reranker 'hosted' needs a key in {key.key_name}")
        self.key, self.attempts, self.wait, self.timeout = key, attempts, wait, timeout

    def _post(self, body: dict) -> dict:
        head = {"Content-Type": "application/json"}
        if self.key.key_name:
            head["Authorization"] = f"Bearer {os.environ[self.key.key_name]}"
        request = urllib.request.Request(self.key.url, json.dumps(body).encode(), head)
        for i in range(self.attempts):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                if e.code not in RETRIED or i + 1 == self.attempts:
                    raise
            except (urllib.error.URLError, TimeoutError):
                if i + 1 == self.attempts:
                    raise
            time.sleep(self.wait * 2**i)
        raise AssertionError("unreachable")

    def of_one(self, query: str, texts: list[str]) -> list[float | None]:
        got = self._post({"model": self.key.model, "query": query, "documents": texts, "top_n": len(texts)})
        out: list[float | None] = [None] * len(texts)
        for r in got["results"]:
            out[int(r["index"])] = float(r["relevance_score"])
        return out


def rank_messages(query: str, texts: list[str], limit: int) -> list[dict]:
    listed = "\n".join(f"[{i}] {t}" for i, t in enumerate(texts, 1))
    return [{"role": "user", "content": f"Order these passages by how much they help to answer the question. Reply with the numbers of the best {limit}, the best first, separated by commas, and nothing else.\n\nQuestion: {query}\n\nPassages:\n{listed}"}]


_MADE: dict[tuple, object] = {}
_BUILDERS: dict[str, Callable[[Key], object]] = {"local": CrossEncoder, "hosted": Hosted}


def in_worker(key: Key, build: Callable[[Key], object] | None = None):
    """The reranker of these settings in this Python process, made at the first call."""
    if key not in _MADE:
        _MADE[key] = (build or _BUILDERS[key.kind])(key)
    return _MADE[key]


def key_of(s: Settings) -> Key:
    return Key(s.reranker, s.reranker_model, s.reranker_url, s.reranker_key_name)


def _lists(found: DataFrame, shown: int | None = None) -> DataFrame:
    """(qid, query, ids, texts): the candidates of each question by rank; there are at most as many as both legs return."""
    cut = found if shown is None else found.filter(F.col("rank") <= shown)
    return cut.groupBy("qid").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("rank", "id", "content", "score"))).alias("c"))


def by_service(found: DataFrame, key: Key, limit: int, build=None) -> DataFrame:
    """(qid, id, score, rank) by a reranker that takes one question with its texts; texts without a score drop out, as they do in its reply."""
    kinds = {c: found.schema[c].dataType.simpleString() for c in ("qid", "id")}
    src = _lists(found).select("qid", "query", F.transform("c", lambda x: x["id"]).alias("ids"), F.transform("c", lambda x: x["content"]).alias("texts"))

    def run(batches):
        for pdf in batches:
            rows = []
            for qid, query, ids, texts in zip(pdf.qid, pdf["query"], pdf.ids, pdf.texts, strict=True):
                scores = in_worker(key, build).of_one(query, [t or "" for t in texts])
                best = sorted((-s, i) for i, s in enumerate(scores) if s is not None)[:limit]
                rows += [(qid, ids[i], -s, n) for n, (s, i) in enumerate(best, 1)]
            yield pd.DataFrame(rows, columns=["qid", "id", "score", "rank"])

    return src.mapInPandas(run, f"qid {kinds['qid']}, id {kinds['id']}, score double, rank int")


def by_list(found: DataFrame, chat: Callable[[], Callable[[list[dict]], str]], limit: int, shown: int = SHOWN, chars: int = CHARS) -> DataFrame:
    """(qid, id, score, rank) in the order of a model's reply, a list of numbers; scores stay those of the fusion.

    ``chat()`` makes, once a task, the function that answers messages. Only the first ``shown`` candidates take part, each by
    its first ``chars`` characters; numbers out of range and repeated ones are dropped, omitted candidates follow in their order.
    """
    kinds = {c: found.schema[c].dataType.simpleString() for c in ("qid", "id")}
    src = _lists(found, shown).select(
        "qid", "query", F.transform("c", lambda x: x["id"]).alias("ids"), F.transform("c", lambda x: x["score"].cast("double")).alias("scores"),
        F.transform("c", lambda x: F.substring(F.coalesce(x["content"], F.lit("")), 1, chars)).alias("texts"),
    )

    def run(batches):
        ask = None
        for pdf in batches:
            if len(pdf) and ask is None:
                ask = chat()
            replies = [ask(rank_messages(q, list(t), limit)) for q, t in zip(pdf["query"], pdf.texts, strict=True)]
            yield pdf[["qid", "ids", "scores"]].assign(reply=pd.Series(replies, index=pdf.index, dtype=object))

    asked = src.mapInPandas(run, f"qid {kinds['qid']}, ids array<{kinds['id']}>, scores array<double>, reply string")
    order = rank_list(F.coalesce("reply", F.lit("")), F.size("ids"))
    out = asked.select("qid", "ids", "scores", F.posexplode(order).alias("pos", "i")).filter(F.col("pos") < limit)
    return out.select("qid", F.col("ids")[F.col("i")].alias("id"), F.col("scores")[F.col("i")].alias("score"), (F.col("pos") + 1).alias("rank"))


def apply(found: DataFrame, s: Settings, factory: Callable[[str], clients.Client], build: Callable[[Key], object] | None = None) -> DataFrame:
    """(qid, id, score, rank): fused results (qid, id, score, rank, query, content) reranked as the settings say; ``none`` cuts them.

    ``build(key)`` makes a reranker of another kind than the installed one: with ``scores`` for ``local``, with ``of_one`` for ``hosted``.
    """
    if s.reranker == "none":
        return rerank(found, None, s.top_k_final)
    key = key_of(s)
    if s.reranker == "llm":

        def chat():
            client = factory("local")
            return lambda messages: client.chat(messages).text

        return by_list(found, chat, s.top_k_final)
    if s.reranker == "hosted":
        return by_service(found, key, s.top_k_final, build)
    return rerank(found, lambda qs, ts: in_worker(key, build).scores(qs, [t or "" for t in ts]), s.top_k_final)
