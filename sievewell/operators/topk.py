"""Top-k within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group, with their rank from 1.

    Spark limits every group inside each task before the shuffle (a partial group limit), so a task gets at most
    k rows a group from each other task however many rows a group has.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df with its rows numbered from 0 in the given order, which should leave no ties.

    Rows are dealt by ranges of the order and checkpointed, each range is numbered alone, and the ranges' counts give
    the offsets, so no task holds all rows.
    """
    dealt = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))  # a row a partition
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__at", at).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") - 1).drop("__part", "__at", "__before")
