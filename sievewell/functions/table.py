"""Chunking from SQL: a table function for lateral joins.

The DataFrame operator (operators.chunking.chunk_fixed) stays in the JVM and is the faster of the two. A table function in SQL text
would be planned as a join on the whole text, with a shuffle, so this one is in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .text import check_window

#: The characters that separate words, those that have the Unicode property White_Space.
SPACE = re.compile(r"[\t-\r \x85\xa0  -     　]+")


def windows(text: str | None, size: int, overlap: int) -> list[str]:
    """The word windows of one text, as functions.text.word_windows makes them."""
    w = [x for x in SPACE.split(text or "") if x]
    step = size - overlap
    count = 0 if not w else max(0, -(-(len(w) - size) // step)) + 1
    return [" ".join(w[i * step : i * step + size]) for i in range(count)]


@udtf(returnType="chunk_index int, content string", useArrow=True)
class Chunk:
    """``SELECT d.id, c.* FROM d, LATERAL chunk(d.text, 512, 64) c``: no shuffle; rows travel in Arrow batches."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        check_window(size, overlap)
        yield from enumerate(windows(text, size, overlap))


def register(spark: SparkSession) -> None:
    """Makes ``chunk`` known to the session's SQL."""
    spark.udtf.register("chunk", Chunk)
