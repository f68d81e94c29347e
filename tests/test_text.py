import random

import pytest
from pyspark.sql import functions as F

from sievewell.config import Settings
from sievewell.functions import parse, text
from sievewell.operators import chunking
from sievewell.plans.clients import HashingEmbedder


def windows(w, size, overlap):
    out, at = [], 0
    while at < len(w):
        out.append(" ".join(w[at : at + size]))
        if at + size >= len(w):
            break
        at += size - overlap
    return out


@pytest.mark.parametrize(("size", "overlap"), [(10, 2), (512, 64), (1, 0), (3, 2)])
def test_word_windows(spark, size, overlap):
    rnd = random.Random(5)
    docs = [(i, " ".join(f"w{rnd.randrange(99)}" for _ in range(n))) for i, n in enumerate([0, 1, 3, 9, 10, 11, 18, 19, 512, 513, 1000])]
    got = chunking.chunk_fixed(spark.createDataFrame(docs, "id int, text string"), "id", "text", size, overlap).collect()
    for i, t in docs:
        assert [r.content for r in sorted((r for r in got if r.id == i), key=lambda r: r.chunk_index)] == windows(t.split(), size, overlap)


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (10, 10), (10, 11), (5, -1)])
def test_bad_windows(spark, size, overlap):
    with pytest.raises(ValueError):
        chunking.chunk_fixed(spark.range(1).withColumn("text", F.lit("x")), "id", "text", size, overlap)


def test_semantic(spark):
    t = "Cats purr loudly. Cats purr softly. Markets fell sharply today. Markets fell again today."
    df = spark.createDataFrame([(1, t), (2, "one only"), (3, ""), (4, None)], "id int, text string")
    got = sorted((r.id, r.chunk_index, r.content) for r in chunking.chunk(df, "id", "text", Settings(chunk_strategy="semantic", semantic_threshold=0.3), HashingEmbedder(256)).collect())
    assert got == [(1, 0, "Cats purr loudly. Cats purr softly."), (1, 1, "Markets fell sharply today. Markets fell again today."), (2, 0, "one only")]
    with pytest.raises(ValueError):
        Settings(chunk_strategy="other")


def test_sentences_and_tokens(spark):
    row = spark.createDataFrame([("Hi there!  You?\n\n\nNew。 part  ", "Ärger_x 12-b")], "a string, b string").select(text.sentences(F.col("a")).alias("s"), text.tokens(F.col("b")).alias("t")).first()
    assert row.s == ["Hi there!", "You?", "New。", "part"] and row.t == ["ärger_x", "12", "b"]


def test_replies(spark):
    df = spark.createDataFrame([("SCORE: 250\nPOINTS: x",), ("no score, but points",), ("points: None",), ("",)], "r string")
    assert [tuple(r) for r in df.select(parse.map_score(F.col("r")), parse.map_points(F.col("r"))).collect()] == [(100, "x"), (50, "no score, but points"), (0, "None"), (0, "")]
    ranks = spark.createDataFrame([("2, 9, 2, 1",), ("none",)], "r string").select(parse.rank_list(F.col("r"), F.lit(3)).alias("o"))
    assert [r.o for r in ranks.collect()] == [[1, 0, 2], [0, 1, 2]]
    scores = spark.createDataFrame([("0.85 of 1",), ("7",), ("x",)], "r string").select(parse.judge_score(F.col("r")).alias("s"))
    assert [r.s for r in scores.collect()] == [0.85, 1.0, 0.0]
