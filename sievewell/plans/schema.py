"""What a model is told about tables: signatures, sample rows, and the tables that a question needs."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def list_columns(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in spark.table(name).schema]


def signature(spark: SparkSession, name: str) -> str:
    """A line for the table; no data is read."""
    return f"TABLE {name} ({', '.join(f'{c} {t}' for c, t in list_columns(spark, name))})"


def describe(spark: SparkSession, names: list[str] | None = None, rows: int = 3) -> str:
    """Signatures and sample rows, in the given order. Samples are the first rows by the first column, so they are the same each time."""
    names = list_tables(spark) if names is None else names
    if not names:
        raise ValueError("there are no tables")
    out = []
    for n in names:
        t = spark.table(n)
        sample = t.orderBy(t.columns[0]).limit(rows).collect() if t.columns else []
        out.append("\n".join([signature(spark, n), *("  " + ", ".join(f"{k}={v!r}" for k, v in r.asDict().items()) for r in sample)]))
    return "\n\n".join(out)


def lexical_rank(question: str, signatures: dict[str, str]) -> list[tuple[str, int]]:
    """(table, score), best first: how many words of the question contain or are contained in a word of the signature."""
    words = lambda s: [w for w in re.findall(r"[a-z0-9]+", s.lower()) if len(w) >= 3]
    asked = set(words(question))
    scored = [(n, sum(any(a in b or b in a for b in set(words(s))) for a in asked)) for n, s in signatures.items()]
    return sorted(scored, key=lambda x: -x[1])


def embedding_rank(question: str, signatures: dict[str, str], embed: Callable[[list[str]], np.ndarray]) -> list[str] | None:
    """Tables by cosine; None if embedding fails."""
    try:
        v = np.asarray(embed([question, *signatures.values()]), float)
    except Exception:
        return None
    n = np.linalg.norm(v, axis=1)
    score = v[1:] @ v[0] / np.where(n[1:] * n[0] > 0, n[1:] * n[0], 1)
    return [list(signatures)[i] for i in np.argsort(-score, kind="stable")]


def fuse_names(rankings: list[list[str]], k: int = 60) -> list[str]:
    score: dict[str, float] = {}
    for r in rankings:
        for i, n in enumerate(r, 1):
            score[n] = score.get(n, 0.0) + 1 / (k + i)
    return sorted(score, key=lambda n: -score[n])


def narrow(spark: SparkSession, question: str, top_k: int = 8, embed: Callable | None = None, names: list[str] | None = None) -> list[str]:
    """The tables that a question needs; all of them, without embedding anything, if there are not more than ``top_k``."""
    names = list_tables(spark) if names is None else names
    if top_k <= 0 or len(names) <= top_k:
        return names
    signatures = {n: signature(spark, n) for n in names}
    rankings = [[n for n, _ in lexical_rank(question, signatures)]]
    if embed and (by_vector := embedding_rank(question, signatures, embed)):
        rankings.append(by_vector)
    return fuse_names(rankings)[:top_k]
