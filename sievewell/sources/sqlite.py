"""A read-only SQLite source for ``spark.read.format("sqlite")``, split by row id."""

from __future__ import annotations

import os
import sqlite3
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType


def _open(path: str) -> sqlite3.Connection:
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    return sqlite3.connect(f"file:{quote(os.path.abspath(path))}?mode=ro", uri=True)


def _type(declared: str):
    d = declared.upper()
    if "INT" in d:
        return LongType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return DoubleType()
    return BinaryType() if "BLOB" in d else StringType()


def list_tables(path: str) -> list[str]:
    with _open(path) as c:
        return [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite!_%' ESCAPE '!' ORDER BY name")]


class SQLiteSource(DataSource):
    """Options: path, dbtable, numPartitions. Values that do not fit a column's declared type are null."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as c:
            cols = c.execute(f'PRAGMA table_info("{self.options["dbtable"]}")').fetchall()
        if not cols:
            raise ValueError(f"no table {self.options['dbtable']}")
        return StructType([StructField(x[1], _type(x[2] or "TEXT")) for x in cols])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["dbtable"], int(self.options.get("numPartitions", "1")), schema)


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, parts: int, schema: StructType):
        self.path, self.table, self.parts, self.fields = path, table, parts, [(f.name, f.dataType) for f in schema]

    def partitions(self):
        with _open(self.path) as c:
            try:
                low, high = c.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
            except sqlite3.OperationalError:  # a view or a table without row ids
                return [_Range(None, None)]
        if low is None or self.parts <= 1:
            return [_Range(None, None)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, part):
        names = ", ".join(f'"{n}"' for n, _ in self.fields)
        where = "" if part.low is None else f" WHERE rowid >= {part.low} AND rowid < {part.high}"
        with _open(self.path) as c:
            c.text_factory = lambda b: b.decode("utf-8", "replace")
            for row in c.execute(f'SELECT {names} FROM "{self.table}"{where}'):
                yield tuple(_cast(v, t) for v, (_, t) in zip(row, self.fields, strict=True))


def _cast(v, kind):
    if v is None:
        return None
    try:
        if isinstance(kind, LongType):
            return int(v)
        if isinstance(kind, DoubleType):
            return float(v)
    except (TypeError, ValueError):
        return None
    if isinstance(kind, BinaryType):
        return v if isinstance(v, bytes) else str(v).encode()
    return v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)


def read_table(spark: SparkSession, path: str, name: str, partitions: int = 1) -> DataFrame:
    spark.dataSource.register(SQLiteSource)
    return spark.read.format("sqlite").option("path", path).option("dbtable", name).option("numPartitions", partitions).load()


def register_all(spark: SparkSession, path: str) -> list[str]:
    """Registers every table of the file as a temporary view."""
    names = list_tables(path)
    for n in names:
        read_table(spark, path, n).createOrReplaceTempView(n)
    return names
