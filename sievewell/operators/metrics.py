"""Evaluation: retrieval metrics, agreement of result sets, percentiles, summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _top(retrieved: Column, k: int) -> Column:
    return F.slice(retrieved, 1, k) if k > 0 else F.slice(retrieved, 1, 0)


def recall_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of the relevant sources among the first k retrieved ones; 0 without relevant ones."""
    wanted = F.array_distinct(relevant)
    n = F.size(wanted)
    return F.when(n > 0, F.size(F.array_intersect(_top(retrieved, k), wanted)) / F.when(n > 0, n)).otherwise(0.0)


def reciprocal_rank(retrieved: Column, relevant: Column, k: int) -> Column:
    ranks = F.filter(F.transform(_top(retrieved, k), lambda x, i: F.when(F.array_contains(relevant, x), i + 1)), lambda r: r.isNotNull())
    return F.coalesce(1.0 / F.array_min(ranks), F.lit(0.0))


def hit(retrieved: Column, relevant: Column, k: int) -> Column:
    return (F.size(F.array_intersect(_top(retrieved, k), relevant)) > 0).cast("double")


def per_query(df: DataFrame, k: int, retrieved: str = "retrieved", relevant: str = "relevant") -> DataFrame:
    r, w = F.col(retrieved), F.col(relevant)
    return df.withColumns({"recall": recall_at_k(r, w, k), "mrr": reciprocal_rank(r, w, k), "hit": hit(r, w, k)})


def summary(scored: DataFrame, by: list[str] | None = None, relevant: str = "relevant") -> DataFrame:
    """Means over the labelled queries only; zeros without any."""
    labelled = F.size(relevant) > 0
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(labelled, F.col(c))), F.lit(0.0)), 6).alias(c)
    return scored.groupBy(*(by or [])).agg(F.count(F.when(labelled, 1)).alias("n"), mean("recall"), mean("mrr"), mean("hit"))


def percentile(c: Column | str, p: float) -> Column:
    """Linear interpolation; 0 for no rows."""
    return F.coalesce(F.percentile(c, F.lit(p)), F.lit(0.0))


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """df with numbers as rounded doubles and all else as text, for comparing result sets."""
    numeric = ("int", "bigint", "smallint", "tinyint", "float", "double")
    return df.select(*[F.round(F.col(f"`{n}`").cast("double"), digits).alias(f"c{i}") if t in numeric or t.startswith("decimal") else F.col(f"`{n}`").cast("string").alias(f"c{i}") for i, (n, t) in enumerate(df.dtypes)])


def same_rows(a: DataFrame, b: DataFrame, digits: int = 4) -> bool:
    """Whether two results are equal as bags, in any order, numbers being rounded; a distributed check."""
    if len(a.columns) != len(b.columns):
        return False
    x, y = rounded(a, digits), rounded(b, digits)
    if x.dtypes != y.dtypes:
        x, y = (z.select(*[F.col(c).cast("string") for c in z.columns]) for z in (x, y))
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def rows_match(a: list[tuple], b: list[tuple], rel: float = 1e-4, abs_: float = 1e-6) -> bool:
    """Bag equality of two small results, numbers within a tolerance, all else as text."""

    def equal(x, y) -> bool:
        try:
            return math.isclose(float(x), float(y), rel_tol=rel, abs_tol=abs_)
        except (TypeError, ValueError):
            return str(x) == str(y)

    left = list(b)
    if len(a) != len(left):
        return False
    for row in a:
        at = next((i for i, o in enumerate(left) if len(o) == len(row) and all(map(equal, row, o))), None)
        if at is None:
            return False
        left.pop(at)
    return True
