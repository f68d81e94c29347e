"""Backends of the SQL path by name, and the demonstration table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import sqlite

# The demonstration's rows (region, product, amount, sold_at).
DEMO = (
    ("north", "widget", 1200.0, "2024-02-11"), ("north", "gadget", 800.0, "2024-05-03"), ("south", "widget", 1500.0, "2024-07-19"),
    ("south", "gizmo", 600.0, "2024-11-30"), ("central", "widget", 900.0, "2024-09-09"), ("north", "widget", 2000.0, "2025-01-15"),
    ("north", "gadget", 500.0, "2025-03-22"), ("south", "gizmo", 1100.0, "2025-06-01"), ("central", "gadget", 700.0, "2025-08-08"),
    ("central", "widget", 1300.0, "2025-10-10"),
)


def _sqlite(spark: SparkSession, path: str) -> list[str]:
    return sqlite.register_all(spark, path)


def _duckdb(spark: SparkSession, path: str) -> list[str]:
    """Tables of a DuckDB file, opened read-only; they must fit the driver. Larger ones are better exported to Parquet."""
    import duckdb

    if not Path(path).is_file():
        raise FileNotFoundError(path)
    with duckdb.connect(path, read_only=True) as c:
        names = [r[0] for r in c.execute("SELECT table_name FROM information_schema.tables WHERE table_schema = 'main' ORDER BY table_name").fetchall()]
        for n in names:
            spark.createDataFrame(c.execute(f'SELECT * FROM "{n}"').df()).createOrReplaceTempView(n)
    return names


def _parquet(spark: SparkSession, path: str) -> list[str]:
    """A folder of Parquet tables, each a file or folder ``<name>.parquet``."""
    from ..sources.store import list_names

    names = sorted(n.removesuffix(".parquet") for n in list_names(spark, path) if n.endswith(".parquet"))
    for n in names:
        spark.read.parquet(f"{path}/{n}.parquet").createOrReplaceTempView(n)
    return names


BACKENDS = {"sqlite": _sqlite, "duckdb": _duckdb, "parquet": _parquet}


def open_backend(spark: SparkSession, kind: str, path: str) -> list[str]:
    """Registers a backend's tables as views and returns their names."""
    if kind not in BACKENDS:
        raise ValueError(f"unknown backend {kind!r}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[kind](spark, path)


def demo_sales(spark: SparkSession) -> DataFrame:
    """The demonstration's ``sales`` table (id, region, product, amount, sold_at), also as a view."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(DEMO, 1)], "id int, region string, product string, amount double, sold_at string")
    df.createOrReplaceTempView("sales")
    return df
