"""Documents to chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import check_window, sentences, strip, word_windows, words


def chunk_fixed(docs: DataFrame, key: str, text: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """(key, chunk_index, content): word windows. One narrow stage, no shuffle."""
    check_window(size, overlap)
    w = docs.select(key, words(F.col(text)).alias("__w"))
    return w.select(key, F.posexplode(word_windows(F.col("__w"), size, overlap)).alias("chunk_index", "content"))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / n if n else 0.0


def fold_sentences(parts: list[str], vectors: np.ndarray, threshold: float, max_words: int) -> list[str]:
    """Joins adjacent sentences while they are similar enough and the chunk is not too long."""
    out, words_, last = [[parts[0]]], len(parts[0].split()), vectors[0]
    for s, v in zip(parts[1:], vectors[1:], strict=True):
        n = len(s.split())
        if cosine(last, v) < threshold or words_ + n > max_words:
            out.append([])
            words_ = 0
        out[-1].append(s)
        words_, last = words_ + n, v
    return [" ".join(x) for x in out]


def chunk_semantic(docs: DataFrame, key: str, text: str, embed, threshold: float = 0.5, max_words: int = 512) -> DataFrame:
    """(key, chunk_index, content): adjacent sentences of similar vectors. ``embed(list of str) -> array`` runs in the tasks.

    A text of at most one sentence is one chunk, stripped; an over-long sentence stays whole.
    """
    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("k"), strip(F.coalesce(text, F.lit(""))).alias("t"), sentences(F.col(text)).alias("s")).filter("t <> ''")

    def run(batches):
        for pdf in batches:
            rows = []
            for k, t, s in zip(pdf.k, pdf.t, pdf.s, strict=True):
                chunks = [t] if len(s) <= 1 else fold_sentences(list(s), embed(list(s)), threshold, max_words)
                rows += [(k, i, c) for i, c in enumerate(chunks)]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "content"])

    return src.mapInPandas(run, f"`{key}` {kind}, chunk_index int, content string")


def chunk(docs: DataFrame, key: str, text: str, settings: Settings, embed=None) -> DataFrame:
    """By the strategy of the settings; the semantic one needs ``embed``."""
    if settings.chunk_strategy == "semantic":
        if embed is None:
            raise ValueError("semantic chunking needs an embedder")
        return chunk_semantic(docs, key, text, embed, settings.semantic_threshold, settings.chunk_size)
    return chunk_fixed(docs, key, text, settings.chunk_size, settings.chunk_overlap)
