"""Stored tables: chunks, graphs and logs.

A stored table is a folder of versions and a small file for each version that names its data. A new version is written
aside and becomes current when its file is made, which fails if another writer has made one of that number meanwhile.
So readers see a whole version, a failed write changes nothing, and of two writers one fails. The data of the last KEEP
versions stay, for readers that have begun.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = "id bigint, source string, chunk_index int, content string, embedding array<float>, created_at timestamp"
LOG_SCHEMA = "id bigint, query string, answer string, num_citations int, latency_ms bigint, created_at timestamp, route string, model string, input_tokens bigint, output_tokens bigint, cost_usd double, router_reason string, difficulty double"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


#: Versions of a table whose data stay.
KEEP = 3


class Conflict(RuntimeError):
    """Another writer has replaced the table since it was read."""


class Versioned:
    """A table at a path, replaced as a whole. A replacement goes on from the version that was read last through this object."""

    def __init__(self, spark: SparkSession, path: str, schema: str, fmt: str = "parquet"):
        self.spark, self.path, self.schema, self.format = spark, path.rstrip("/"), schema, fmt
        self._seen: int | None = None

    def _numbers(self) -> list[int]:
        return sorted(int(n) for n in list_names(self.spark, f"{self.path}/versions") if n.isdigit())

    def _data(self, number: int) -> str:
        return self._lines(number)[0]

    def _lines(self, number: int) -> list[str]:
        return self.spark.read.text(f"{self.path}/versions/{number}", wholetext=True).first()[0].split("\n")

    def marks(self) -> dict[str, int]:
        """What writers have noted in the version that was read last, or in the current one."""
        number = max(self._numbers(), default=0) if self._seen is None else self._seen
        lines = self._lines(number) if number else []
        return json.loads(lines[1]) if len(lines) > 1 else {}

    def exists(self) -> bool:
        return bool(self._numbers())

    def read(self) -> DataFrame:
        self._seen = max(self._numbers(), default=0)
        if not self._seen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).format(self.format).load(f"{self.path}/{self._data(self._seen)}")

    def replace(self, df: DataFrame, marks: dict[str, int] | None = None) -> None:
        """Raises Conflict, and changes nothing, if the table is not the one that was read. ``marks`` are noted with the version; earlier ones stay."""
        noted = self.marks() | (marks or {})
        number = (max(self._numbers(), default=0) if self._seen is None else self._seen) + 1
        name = f"v-{uuid.uuid4().hex}"
        df.write.format(self.format).save(f"{self.path}/{name}")
        fs, p = _fs(self.spark, f"{self.path}/versions/{number}")
        path = lambda x: self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}")
        try:
            out = fs.create(p, False)  # fails if it is there
        except Exception as e:
            fs.delete(path(name), True)
            raise Conflict(f"{self.path}: version {number} is there already") from e
        out.write(bytearray(f"{name}\n{json.dumps(noted)}".encode()))
        out.close()
        self._seen = number
        for old in self._numbers():
            if old <= number - KEEP:
                fs.delete(path(self._data(old)), True)
                fs.delete(path(f"versions/{old}"), False)


def replace_by_key(old: DataFrame, new: DataFrame, keys: DataFrame, key: str = "source") -> DataFrame:
    """old without the rows of any key in ``keys``, and new. A key of ``keys`` without new rows loses its rows."""
    return old.join(keys.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


class Corpus:
    """The chunk table."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = Versioned(spark, path, CHUNK_SCHEMA)

    def chunks(self) -> DataFrame:
        return self.table.read()

    def ingest(self, docs: DataFrame, settings, embed, marks: dict[str, int] | None = None) -> dict[str, int]:
        """Chunks, embeds and stores documents (source, text); chunks of these sources are replaced, also by none."""
        from ..operators.chunking import chunk

        spark = docs.sparkSession
        parts = chunk(docs, "source", "text", settings, embed).filter("trim(content) <> ''")

        def vectors(batches):
            for pdf in batches:
                v = embed(list(pdf.content)) if len(pdf) else []
                yield pdf.assign(embedding=[[float(x) for x in row] for row in v])

        made = parts.mapInPandas(vectors, "source string, chunk_index int, content string, embedding array<float>")
        made = made.withColumn("id", F.xxhash64("source", "chunk_index")).withColumn("created_at", F.current_timestamp())
        old = self.chunks()
        self.table.replace(replace_by_key(old, made, docs.select("source")), marks)
        here = self.chunks().join(F.broadcast(docs.select("source").distinct()), "source", "left_semi") if docs.count() <= 100_000 else self.chunks().join(docs.select("source").distinct(), "source", "left_semi")
        r = here.agg(F.countDistinct("source").alias("d"), F.count("*").alias("c")).first()
        return {"documents": r.d, "chunks": r.c}

    def sources(self) -> DataFrame:
        return list_sources(self.chunks())

    def delete(self, source: str) -> int:
        """Removes a source's chunks and returns how many there were."""
        old = self.chunks()
        n = old.filter(F.col("source") == source).count()
        if n:
            self.table.replace(old.filter(F.col("source") != source))
        return n


def list_sources(chunks: DataFrame, at: str = "created_at") -> DataFrame:
    """(source, chunks, ingested), the last ingested first."""
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.max(at).alias("ingested")).orderBy(F.desc("ingested"), "source")


class GraphStore:
    """Entities, relationships and communities, as JSON or Parquet tables."""

    SCHEMAS = {
        "entities": "key string, name string, type string, description string, chunk_ids array<bigint>",
        "relationships": "source string, target string, description string",
        "communities": "id int, summary string, entity_names array<string>, sources array<string>, embedding array<double>",
    }

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet"):
        if fmt not in ("parquet", "json"):
            raise ValueError(f"unknown graph store {fmt!r}; known: json, parquet")
        self.tables = {n: Versioned(spark, f"{path}/{n}", s, fmt) for n, s in self.SCHEMAS.items()}

    def exists(self) -> bool:
        return all(t.exists() for t in self.tables.values())

    def save(self, entities: DataFrame, relationships: DataFrame, communities: DataFrame, embed=None) -> None:
        """Stores the tables; summaries without an embedding get one where there is an embedder."""
        if embed is not None:

            def embedded(batches):
                for pdf in batches:
                    lacks = [i for i, (s, v) in enumerate(zip(pdf.summary, pdf.embedding, strict=True)) if s and (v is None or not len(v))]
                    vectors = list(pdf.embedding)
                    for i, v in zip(lacks, embed([pdf.summary.iloc[i] for i in lacks]) if lacks else [], strict=True):
                        vectors[i] = [float(x) for x in v]
                    yield pdf.assign(embedding=pd.Series(vectors, index=pdf.index, dtype=object))

            names = [f.split()[0] for f in self.SCHEMAS["communities"].split(", ")]
            typed = communities.withColumns({"id": F.col("id").cast("int"), "embedding": F.col("embedding").cast("array<double>")})
            communities = typed.select(*names).mapInPandas(embedded, self.SCHEMAS["communities"])
        for n, df in (("entities", entities), ("relationships", relationships), ("communities", communities)):
            t = self.tables[n]
            t.replace(df.select(*[F.col(f.name).cast(f.dataType) for f in df.sparkSession.createDataFrame([], t.schema).schema]))

    def load(self) -> dict[str, DataFrame]:
        return {n: t.read() for n, t in self.tables.items()}

    def indexed_sources(self) -> DataFrame:
        return self.tables["communities"].read().select(F.explode("sources").alias("source")).distinct()


def append_log(log: DataFrame, path: str) -> None:
    """Appends rows to the query log, which is partitioned by day."""
    log.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def recent(log: DataFrame, limit: int = 20, routed: bool = False) -> DataFrame:
    """The last rows; with ``routed`` those with a route only."""
    rows = log.filter("route is not null") if routed else log
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def events(log: DataFrame) -> DataFrame:
    """(value): a JSON object for each query; scores rounded to 4 places and costs to 6. To be written with ``write.text``."""
    rounded = {c: F.round(c, 4) for c in ("difficulty",) if c in log.columns} | {c: F.round(c, 6) for c in ("cost_usd",) if c in log.columns}
    return log.withColumns(rounded).select(F.to_json(F.struct(*log.columns)).alias("value"))


def append_new(fact: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` that the fact table does not have yet."""
    return new.join(fact.select(key), key, "left_anti")
