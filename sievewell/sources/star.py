"""Extension: a star schema in Parquet: dimensions with stable surrogate keys, facts merged by day, loads that may be repeated.

A surrogate key is a hash of the dimension's name and the natural key as text, so loads need no common counter and a reload, in any order
or at once with others, gives the same keys. Key 0 stands for an unknown (null) natural key. A fact may come before
its dimension's row: such members are inferred, and a later load of the dimension fills them in without touching facts.

Facts lie in a folder for each day. A load rewrites the days that its rows, or older versions of these, lie in, and no others: the merged
days are written aside first and put in place by a dynamic overwrite, so a load that fails is repaired by running it again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import _fs

UNKNOWN = 0
#: Days that a load touches are broadcast up to this number (27 years).
BROADCAST_DAYS = 10_000


class KeyCollision(ValueError):
    """Two natural keys of a dimension have one surrogate key."""


@dataclass(frozen=True)
class Dimension:
    """``key``: the natural key's column; ``attributes``: DDL of the columns that describe a member."""

    name: str
    key: str
    attributes: str = ""

    def sk(self, c: Column) -> Column:
        return F.when(c.isNull(), F.lit(UNKNOWN).cast("bigint")).otherwise(F.xxhash64(F.lit(self.name), c.cast("string")))

    @property
    def schema(self) -> str:
        return f"{self.name}_sk bigint, {self.key} string, {self.attributes + ', ' if self.attributes else ''}inferred boolean"


@dataclass(frozen=True)
class Fact:
    """``key`` names a row, ``at`` is its timestamp, ``version`` orders versions of a row (of equal ones the first by content stays); ``links`` has the dimension of each natural key's column."""

    name: str
    key: str
    at: str
    links: dict[str, Dimension] = field(default_factory=dict)
    version: str | None = None


class Star:
    """The tables of a star schema below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, name: str) -> bool:
        fs, p = _fs(self.spark, f"{self.path}/{name}")
        return fs.exists(p)

    def _remove(self, path: str) -> None:
        fs, p = _fs(self.spark, path)
        fs.delete(p, True)

    def dimension(self, dim: Dimension) -> DataFrame:
        """The members, one of them unknown."""
        if not self._exists(dim.name):
            return self.spark.createDataFrame([], dim.schema)
        return self.spark.read.schema(dim.schema).parquet(f"{self.path}/{dim.name}")

    def fact(self, fact: Fact) -> DataFrame | None:
        return self.spark.read.option("basePath", f"{self.path}/{fact.name}").parquet(f"{self.path}/{fact.name}") if self._exists(fact.name) else None

    def _staged(self, df: DataFrame) -> tuple[DataFrame, str]:
        path = f"{self.path}/_staged/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def load_dimension(self, dim: Dimension, rows: DataFrame, inferred: bool = False) -> None:
        """Members of ``rows`` (the natural key and the attributes); those known already take on the new attributes, unless ``inferred``.

        Of several rows of one key the greatest by its attributes counts. Raises KeyCollision if keys collide.
        """
        names = [f.name for f in self.spark.createDataFrame([], dim.schema).schema][2:-1]
        kinds = {f.name: f.dataType for f in self.spark.createDataFrame([], dim.schema).schema}
        described = F.max(F.struct(*[F.col(n).cast(kinds[n]).alias(n) for n in names])).alias("x") if names and not inferred else F.lit(None).alias("x")
        new = rows.filter(F.col(dim.key).isNotNull()).withColumn(dim.key, F.col(dim.key).cast("string")).groupBy(dim.key).agg(described)
        new = new.select(dim.sk(F.col(dim.key)).alias(f"{dim.name}_sk"), dim.key, *[(F.col(f"x.{n}") if not inferred else F.lit(None).cast(kinds[n])).alias(n) for n in names], F.lit(inferred).alias("inferred"))
        unknown = self.spark.range(1).select(F.lit(UNKNOWN).cast("bigint").alias(f"{dim.name}_sk"), F.lit(None).cast("string").alias(dim.key), *[F.lit(None).cast(kinds[n]).alias(n) for n in names], F.lit(False).alias("inferred"))
        old = self.dimension(dim).filter(F.col(dim.key).isNotNull())
        if inferred:  # only those not known yet
            merged = old.unionByName(new.join(old.select(dim.key), dim.key, "left_anti"))
        else:
            merged = old.join(new.select(dim.key), dim.key, "left_anti").unionByName(new)
        staged, path = self._staged(merged.unionByName(unknown).select(*kinds))
        if not staged.groupBy(f"{dim.name}_sk").count().filter("count > 1").isEmpty():
            self._remove(path)
            raise KeyCollision(dim.name)
        staged.write.mode("overwrite").parquet(f"{self.path}/{dim.name}")
        self._remove(path)

    def load_fact(self, fact: Fact, rows: DataFrame) -> int:
        """Adds rows or newer versions of rows, infers members that dimensions lack, and returns how many days were rewritten.

        ``rows`` has the natural keys' columns; they are replaced by surrogate keys. Rows without a key are refused.
        """
        new, path = self._staged(rows)
        made = [path]
        if not new.filter(F.col(fact.key).isNull()).isEmpty():
            self._remove(path)
            raise ValueError(f"{fact.name}: a row without {fact.key}")
        for column, dim in fact.links.items():
            self.load_dimension(dim, new.select(F.col(column).alias(dim.key)).distinct(), inferred=True)
        keyed = new.select(*[dim.sk(F.col(c)).alias(f"{dim.name}_sk") for c, dim in fact.links.items()], *[c for c in new.columns if c not in fact.links], F.to_date(fact.at).alias("day"))
        old = self.fact(fact)
        if old is not None:
            moved = old.select(fact.key, "day").join(keyed.select(fact.key).distinct(), fact.key, "left_semi").select("day")
            days, at = self._staged(moved.unionByName(keyed.select("day")).distinct())
            made.append(at)
            few = F.broadcast(days) if days.limit(BROADCAST_DAYS + 1).count() <= BROADCAST_DAYS else days
            keyed = old.join(few, old["day"].eqNullSafe(few["day"]), "left_semi").select(*keyed.columns).unionByName(keyed)
        order = F.struct(*[F.col(c) for c in ([fact.version] if fact.version else []) + sorted(c for c in keyed.columns if c != fact.version)])
        merged, at = self._staged(keyed.groupBy(fact.key).agg(F.max(order).alias("x")).select("x.*").select(*keyed.columns))
        made.append(at)
        n = merged.select("day").distinct().count()
        if old is not None:  # a day all of whose rows have moved would stay as it was
            emptied = days.join(merged.select("day").distinct(), "day", "left_anti").filter("day is not null").collect()  # days, at most those that the load touches
            for r in emptied:
                self._remove(f"{self.path}/{fact.name}/day={r.day}")
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{self.path}/{fact.name}")
        for p in made:
            self._remove(p)
        return n

    def joined(self, fact: Fact) -> DataFrame:
        """The fact table with its dimensions' natural keys and attributes. Dimensions are joined by their keys; Catalyst broadcasts small ones."""
        out = self.fact(fact)
        for dim in fact.links.values():
            out = out.join(self.dimension(dim).drop("inferred"), f"{dim.name}_sk", "left")
        return out

    def broken(self, fact: Fact, rules: Callable[..., DataFrame]) -> DataFrame:
        """(rule, n) of the data tests of a fact table that fail: keys and links must be there, and links must have members."""
        links = {f"{d.name}_sk": (self.dimension(d), f"{d.name}_sk") for d in fact.links.values()}
        return rules(self.fact(fact), fact.key, [fact.key, *links], relationships=links)
