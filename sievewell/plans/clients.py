"""The boundary to language models: a protocol, deterministic stand-ins, prompts."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Protocol

import numpy as np

from ..functions.vocabulary import NO_ANSWER


@dataclass(frozen=True)
class Reply:
    text: str
    input_tokens: int = 0
    output_tokens: int = 0


class Client(Protocol):
    """Made inside the tasks by a factory, so it need not be serialisable."""

    def embed(self, texts: list[str]) -> np.ndarray: ...

    def chat(self, messages: list[dict]) -> Reply: ...


class HashingEmbedder:
    """Deterministic bag of words: words of three characters or more, hashed into ``dim`` places, with norm 1."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w{3,}", t.lower()):
                out[i, xxhash.xxh32_intdigest(w.encode()) % self.dim] += 1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.embed(texts)


class Scripted(HashingEmbedder):
    """Answers with canned replies in turn, or by a function of the last message."""

    def __init__(self, reply, dim: int = 64):
        super().__init__(dim)
        self.reply, self.calls = reply, 0

    def chat(self, messages: list[dict]) -> Reply:
        last = messages[-1]["content"]
        text = self.reply(last) if callable(self.reply) else self.reply[min(self.calls, len(self.reply) - 1)]
        self.calls += 1
        return Reply(text, sum(len(m["content"].split()) for m in messages), len(text.split()))


class Extractive(HashingEmbedder):
    """Answers with the first source, cited; the no-answer sentence without sources."""

    def chat(self, messages: list[dict]) -> Reply:
        content = messages[-1]["content"]
        m = re.search(r"\[1\] \(source: .*?\)\n(.*?)(?:\n\n|\Z)", content, re.DOTALL)
        text = f"{m[1].strip()[:200]} [1]" if m else NO_ANSWER
        return Reply(text, sum(len(x["content"].split()) for x in messages), len(text.split()))


def answer_messages(query: str, context: str) -> list[dict]:
    return [
        {"role": "system", "content": f"Answer from the numbered sources only and cite them like [1]. If they do not hold the answer, reply exactly: {NO_ANSWER}"},
        {"role": "user", "content": f"Sources:\n{context}\n\nQuestion: {query}"},
    ]


def sql_messages(query: str, schema: str) -> list[dict]:
    return [
        {"role": "system", "content": "Write one read-only SELECT for Spark SQL that answers the question from these tables. Reply with SQL only."},
        {"role": "user", "content": f"Schema:\n{schema}\n\nQuestion: {query}\n\nSQL:"},
    ]


def sql_answer_messages(query: str, sql: str, table: str) -> list[dict]:
    return [
        {"role": "system", "content": "State the answer in one or two sentences from the query's result only."},
        {"role": "user", "content": f"Question: {query}\n\nSQL:\n{sql}\n\nResult:\n{table}"},
    ]


def extract_messages(content: str) -> list[dict]:
    return [
        {"role": "system", "content": "List entities and relationships, one a line: ENTITY|name|type|description or RELATIONSHIP|source|target|description."},
        {"role": "user", "content": content},
    ]


def map_messages(query: str, summary: str) -> list[dict]:
    return [
        {"role": "system", "content": "Say what the summary tells about the question. Reply as SCORE: 0-100, then POINTS: the points, or none."},
        {"role": "user", "content": f"Question: {query}\n\nSummary:\n{summary}"},
    ]


def reduce_messages(query: str, points: str) -> list[dict]:
    return [{"role": "system", "content": "Answer the question from these points only."}, {"role": "user", "content": f"Question: {query}\n\nPoints:\n{points}"}]


def judge_messages(kind: str, query: str, answer: str, context: str) -> list[dict]:
    """Faithfulness is judged by the sources and the answer alone, relevancy by the question and the answer alone."""
    what, given = {
        "faithfulness": ("how far the sources support the answer; an answer that says it does not know, where the sources do not tell, is fully supported", f"Sources:\n{context}"),
        "relevancy": ("how far the answer addresses the question; that it is not known addresses it in part", f"Question: {query}"),
    }[kind]
    return [{"role": "system", "content": f"Rate {what}. Reply with one number from 0 to 1."}, {"role": "user", "content": f"{given}\n\nAnswer: {answer}"}]
