"""Extensions: continuous ingest of documents and event-time windows over a query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..functions.text import strip
from ..operators.chunking import chunk_fixed
from ..sources.store import Corpus


def watch_directory(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream (source, text) of text files that appear in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).text(folder, wholetext=True)
    return lines.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("source"), strip("value").alias("text")).filter("text <> ''")


def chunk_stream(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    return chunk_fixed(docs, "source", "text", size, overlap)


def start_ingest(docs: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends chunks to a Parquet table, exactly once by the checkpoint; ``once`` stops when all present files are done."""
    w = chunk_stream(docs).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return w.trigger(availableNow=True).start() if once else w.start()


def watch_versions(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """A stream (source, text, modified) of text files that appear in a folder; a later file of the same name, in another subfolder, is its new version. Empty ones stay: they delete."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", True).load(folder)
    path = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(path, r"([^/]+)$", 1).alias("source"), strip("value").alias("text"), F.struct(F.col("_metadata.file_modification_time").alias("at"), path.alias("path")).alias("modified"))


def upsert(corpus: Corpus, batch: DataFrame, batch_id: int, stream: str, settings: Settings, embed) -> bool:
    """Puts the documents of a batch in the place of those of the same source; of several versions in a batch the last modified one counts.

    The number of the batch is committed together with the chunks, so a batch that comes again changes nothing (False).
    """
    corpus.chunks()  # the version that this goes on from
    if corpus.table.marks().get(stream, -1) >= batch_id:
        return False
    last = batch.groupBy("source").agg(F.max_by(F.coalesce("text", F.lit("")), "modified").alias("text"))
    corpus.ingest(last, settings, embed, {stream: batch_id})
    return True


def start_upsert(docs: DataFrame, corpus: Corpus, checkpoint: str, settings: Settings, embed, stream: str = "documents", once: bool = True) -> StreamingQuery:
    """Keeps a corpus equal to the last versions of the documents (source, text, modified) of a stream."""
    w = docs.writeStream.foreachBatch(lambda df, n: upsert(corpus, df, n, stream, settings, embed) and None).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start() if once else w.start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", at: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, by, n, total): tumbling windows; rows later than the watermark are dropped when it runs as a stream."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(at, late)
    grouped = timed.groupBy(F.window(at, width), F.col(by)).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), by, "n", "total")
