"""Expressions that read the replies of language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

SCORE = r"(?i)score\s*[:=]\s*(\d{1,3})"
# Points that say that there is nothing to say.
NOTHING = ("", "none")


def extraction_lines(df: DataFrame, id_col: str, reply_col: str) -> DataFrame:
    """(id, line_no, tag, parts) of ENTITY and RELATIONSHIP lines; parts are stripped, at least four."""
    lines = df.select(id_col, F.posexplode(F.split(F.col(reply_col), "\n")).alias("line_no", "line"))
    clean = F.regexp_replace(strip(F.col("line")), r"^[-* ]+", "")
    parts = F.transform(F.split(clean, r"\|"), strip)
    out = lines.select(id_col, "line_no", parts.alias("parts"))
    return out.filter((F.size("parts") >= 4)).select(id_col, "line_no", F.upper(F.col("parts")[0]).alias("tag"), "parts").filter(F.col("tag").isin("ENTITY", "RELATIONSHIP"))


def entities(lines: DataFrame, id_col: str) -> DataFrame:
    """(id, line_no, name, type, description); the type is ``concept`` where none is given."""
    p = F.col("parts")
    e = lines.filter("tag = 'ENTITY'").select(id_col, "line_no", p[1].alias("name"), F.when(p[2] == "", "concept").otherwise(p[2]).alias("type"), p[3].alias("description"))
    return e.filter("name <> ''")


def relationships(lines: DataFrame, id_col: str) -> DataFrame:
    p = F.col("parts")
    return lines.filter("tag = 'RELATIONSHIP'").select(id_col, "line_no", p[1].alias("source"), p[2].alias("target"), p[3].alias("description")).filter("source <> '' and target <> ''")


def map_points(reply: Column) -> Column:
    """What follows ``POINTS:``; the whole reply without it."""
    return strip(F.when(reply.rlike(r"(?is)points:"), F.regexp_extract(reply, r"(?is)points:(.*)$", 1)).otherwise(reply))


def map_score(reply: Column) -> Column:
    """The score from 0 to 100; without one, 50 if the points say something, else 0."""
    given = F.regexp_extract(reply, SCORE, 1)
    points = F.lower(map_points(reply))
    return F.when(given != "", F.least(F.expr("100"), F.when(given != "", given.cast("int")))).when(points.isin(*NOTHING), 0).otherwise(50)


def judge_score(reply: Column) -> Column:
    """The first unsigned number, at most 1; 0 without any."""
    n = F.regexp_extract(reply, r"\d+(?:\.\d+)?", 0)
    return F.when(n != "", F.least(F.lit(1.0), F.when(n != "", n.cast("double")))).otherwise(0.0)


def rank_list(reply: Column, n: Column) -> Column:
    """0-based order from a list of 1-based numbers: those in range, each once, then the omitted ones."""
    given = F.transform(F.regexp_extract_all(reply, F.lit(r"\d{1,9}"), 0), lambda x: x.cast("int") - 1)
    valid = F.array_distinct(F.filter(given, lambda i: (i >= 0) & (i < n)))
    everything = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.expr("array()").cast("array<int>"))
    return F.concat(valid, F.array_except(everything, valid))
