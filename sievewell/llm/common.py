"""What the training-data operators share: working tables, array sums, word hashes."""

from __future__ import annotations

import tempfile
import uuid
import warnings
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import missing

#: A word is a run of characters other than these (space, and TAB to CR).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, _UPPER, _UPPER.lower())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session may do without; it gets a folder of its own."""
    if lacks := missing(spark):
        warnings.warn(f"the session lacks settings that the operators rely on, see sievewell.session: {lacks}", stacklevel=3)
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sievewell-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/sievewell/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Writes df as Parquet in the shared folder and reads it back: a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def few(df: DataFrame, bound: int) -> DataFrame:
    """df, to be broadcast in joins if it has ``bound`` rows at most. df should be a table already written, as it is counted."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


#: Rows of one key that a task of a join gets, about, where the key is known to be frequent.
ROWS_A_SALT = 50_000


def spread_join(left: DataFrame, right: DataFrame, on: str | list[str], rows: str | None, salt_by: Column, how: str = "inner", bound: int = 1_000_000) -> DataFrame:
    """left joined with right, a written table, on keys that very many rows of left may have, but few of right.

    A right side of ``bound`` rows at most is broadcast. Beyond, frequent keys are salted: their rows of left are dealt
    by ``salt_by``, a hash of other columns of theirs, to tasks of about ROWS_A_SALT rows, each with a copy of right's
    rows of the key. The column ``rows`` of right says how many rows of left have the key, and is dropped; None: they are counted.
    """
    keys = [on] if isinstance(on, str) else on
    if right.limit(bound + 1).count() <= bound:
        return left.join(F.broadcast(right.drop(rows) if rows else right), keys, how)
    if rows is None:
        sizes, _ = materialize(left.groupBy(*keys).agg(F.count("*").alias("__sw_rows")).filter(F.col("__sw_rows") > ROWS_A_SALT), "frequent")
        right, rows = right.join(few(sizes, bound), keys, "left"), "__sw_rows"
    salts = F.greatest(F.ceil(F.coalesce(rows, F.lit(1)) / ROWS_A_SALT), F.lit(1)).cast("int")
    hot = right.filter(salts > 1).select(*keys, salts.alias("__sw_salts")).distinct()  # at most rows of left / ROWS_A_SALT
    dealt = left.join(few(hot, bound), keys, "left").withColumn("__sw_salt", F.coalesce(F.pmod(salt_by, F.col("__sw_salts")).cast("int"), F.lit(0))).drop("__sw_salts")
    copied = right.withColumn("__sw_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop(rows)
    return dealt.join(copied, [*keys, "__sw_salt"], how).drop("__sw_salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


# --- sums of arrays over all partitions -------------------------------------------------------------------------


def pack(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype)


BLOB = pa.schema([("blob", pa.binary())])


def blob_batch(b: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b], pa.binary())], schema=BLOB)


def array_sum(df: DataFrame, of_batches: Callable[[Iterator[pa.RecordBatch]], np.ndarray], dtype, fan_in: int = 16, combine: Callable = np.add) -> np.ndarray | None:
    """The sum (or what ``combine`` makes) over all partitions of the array that ``of_batches`` makes of each.

    Each task sends one compressed array of fixed length. They are added in a tree of ``fan_in`` arrays a task, so
    that neither a task nor the driver ever holds many. Returns None when there are no partitions.
    """

    def first(batches):
        yield blob_batch(pack(of_batches(batches)))

    def more(batches):
        total = None
        for b in batches:
            for x in b.column(0):
                a = unpack(x.as_py(), dtype)
                total = a.copy() if total is None else combine(total, a, out=total)
        if total is not None:
            yield blob_batch(pack(total))

    n = df.rdd.getNumPartitions()
    out = df.mapInArrow(first, "blob binary")
    while n > 1:
        n = -(-n // fan_in)
        out = out.repartition(n).mapInArrow(more, "blob binary")
    rows = out.collect()
    return unpack(bytes(rows[0].blob), dtype).copy() if rows else None


# --- hashes -----------------------------------------------------------------------------------------------------


class WordHashes(dict):
    """64-bit hashes by word (bytes); forgets all when it holds too many."""

    LIMIT = 200_000

    def __missing__(self, w: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def mix64(x: np.ndarray) -> np.ndarray:
    """Stirs the bits of unsigned 64-bit numbers (a finalizer of the multiply and shift kind)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    col = batch.column(batch.schema.get_field_index(name))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def ddl(df: DataFrame, *names: str) -> str:
    """The schema of some columns, as text."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)
