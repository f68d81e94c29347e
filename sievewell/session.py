"""A Spark session with what the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that a session may take on while it runs, see prepare().
RUNTIME = {
    # unions that keep their inputs' partitioning fail when adaptive execution gives these different numbers of partitions
    "spark.sql.unionOutputPartitioning": "false",
    # batches for Python workers: bounded by bytes, as texts can be long; the JVM and the worker hold a batch each
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.runSQLOnFiles": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
} | RUNTIME


def prepare(spark: SparkSession) -> None:
    """Sets what RUNTIME has and the session's owner has not set. For applications; the library changes no session."""
    given = spark.conf.getAll
    for name, value in RUNTIME.items():
        if name not in given:
            spark.conf.set(name, value)


def missing(spark: SparkSession) -> str:
    """Settings of RUNTIME without which some plans fail and that the session does not have."""
    name = "spark.sql.unionOutputPartitioning"
    return "" if spark.conf.getAll.get(name) == RUNTIME[name] else f"{name}={RUNTIME[name]}"


def build_session(app: str = "sievewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with CONF; more settings as keyword arguments with ``_`` for ``.``, or in ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=CONF | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
