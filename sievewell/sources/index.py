"""A stored keyword index: postings by term bucket and document block with block maxima, updated by source.

An update writes a segment of its own: postings in a folder for each bucket of terms, its documents, and the sources that
it replaces. The segment counts from when its commit file is there; of two writers that want the same number one fails
and may try again, and readers keep to the commits that they saw. Documents of sources that a later segment replaces
are left out when read, until compact() writes all that is live as one segment.

Texts are dealt by block once and counted inside it, so that what is shuffled besides them is entries of a term and block. A segment has
as many blocks as keep one near BLOCK_DOCS documents, and ``doc_blocks`` at least.

A search reads the buckets of its terms only. It first reads the block maxima, which bound what a block can give to a
question, scores the PROBE most promising blocks of each question, and then those blocks only whose bound reaches the k-th score
so far. Documents that do not reach it are dropped before any join. While an id is live in more than one
segment, no block's bound holds for it, so all blocks are read until compact(). The results are those of a scan.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.graph import ensure_checkpoint_dir
from ..operators.retrieval import if_few, question_terms
from ..operators.topk import top_k
from .store import _fs, list_names

PROBE = 4
#: Documents of a block, on average, where a segment has more than doc_blocks times as many.
BLOCK_DOCS = 4096
#: Rows of dead documents, of replaced sources, and of blocks to be read, that are broadcast.
BROADCAST_ROWS = 250_000
#: Terms of all questions that a scan looks for itself; more are only joined.
SCAN_TERMS = 20_000


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


def entries_of(block: pa.Table) -> pa.Table:
    """(term, block, max_tf, ids, tfs), an entry for each term of one block (id, block, terms), documents by id."""
    ids = block["id"].combine_chunks()
    names = pc.unique(ids)
    names = names.take(pc.sort_indices(names))
    terms = block["terms"].combine_chunks()
    coded = pc.dictionary_encode(terms.flatten())
    doc = pc.index_in(ids, value_set=names).to_numpy()[pc.list_parent_indices(terms).to_numpy()]
    key, tf = np.unique(coded.indices.to_numpy().astype("int64") * len(names) + doc, return_counts=True)
    term = key // max(len(names), 1)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    most = np.maximum.reduceat(tf, starts) if len(starts) else tf
    offsets = pa.array(np.append(starts, len(key)).astype("int32"))
    return pa.table({
        "term": coded.dictionary.take(pa.array(term[starts])), "block": pa.array(np.full(len(starts), block["block"][0].as_py()), pa.int32()), "max_tf": pa.array(most, pa.int64()),
        "ids": pa.ListArray.from_arrays(offsets, names.take(pa.array(key % max(len(names), 1)))), "tfs": pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32())),
    })


class KeywordIndex:
    """``buckets`` of terms and the least number of ``doc_blocks`` are fixed for an index; a block of some hundreds of documents is useful."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, doc_blocks: int = 64, id_type: str = "bigint"):
        self.spark, self.path, self.buckets, self.doc_blocks = spark, path.rstrip("/"), buckets, doc_blocks
        self.postings_schema = f"term string, block int, max_tf bigint, found array<struct<id:{id_type},tf:bigint>>, seg int, bucket int"
        self.docs_schema, self.replaced_schema = f"id {id_type}, source string, seg int", "source string, seg int"

    # --- segments ---

    def commits(self) -> dict[int, str]:
        """The folder of each segment by its number."""
        names = sorted(int(n) for n in list_names(self.spark, f"{self.path}/commits") if n.isdigit())
        rows = {n: self.spark.read.text(f"{self.path}/commits/{n}").first()[0] for n in names}
        base = max((n for n, f in rows.items() if f.startswith("full-")), default=0)
        return {n: f for n, f in rows.items() if n >= base}

    def _commit(self, number: int, folder: str) -> None:
        fs, p = _fs(self.spark, f"{self.path}/commits/{number}")
        try:
            out = fs.create(p, False)  # fails if it is there
        except Exception as e:
            raise Conflict(f"segment {number} is taken") from e
        out.write(bytearray(folder.encode()))
        out.close()

    def _table(self, name: str, schema: str, commits: dict[int, str]) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for i, folder in enumerate(commits.values()):  # few, as compact() makes them one
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/{name}")
            out = out.unionByName(part) if i else part
        return out

    def _write(self, number: int, folder: str, chunks: DataFrame, replaced: DataFrame) -> None:
        at = f"{self.path}/{folder}"
        seg = F.lit(number).alias("seg")
        chunks.select("id", "source", seg).write.parquet(f"{at}/docs")
        replaced.select("source", seg).write.parquet(f"{at}/replaced")
        dealt = chunks.select("id", "content", self._block(self.spark.read.parquet(f"{at}/docs").count())).repartition("block")
        # an entry has a term's documents of a block: its size is bounded by the block's, whatever the term
        kind = self.docs_schema.split(",")[0].partition(" ")[2]
        entry = dealt.select("id", "block", tokens(F.col("content")).alias("terms")).groupBy("block").applyInArrow(entries_of, f"term string, block int, max_tf bigint, ids array<{kind}>, tfs array<int>")
        self._put(entry.select("*", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("bucket")), number, at)

    def _block(self, docs: int) -> Column:
        """A document's block in a segment of so many; numbers mean something within a segment only."""
        return F.pmod(F.xxhash64("id"), F.lit(max(self.doc_blocks, docs // BLOCK_DOCS))).cast("int").alias("block")

    def _put(self, entry: DataFrame, number: int, at: str) -> None:
        """Writes entries (term, block, max_tf, ids, tfs, bucket), a file a bucket. They are dealt as plain arrays, which are a third of the size of structs."""
        found = F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").cast("array<bigint>").alias("tf")).alias("found")
        dealt = entry.repartitionById(self.buckets, "bucket").sortWithinPartitions("bucket", "term", "block")
        dealt.select("term", "block", "max_tf", found, F.lit(number).alias("seg"), "bucket").write.partitionBy("bucket").parquet(f"{at}/postings")

    def update(self, chunks: DataFrame, sources: DataFrame | None = None) -> int:
        """Stores chunks (id, source, content) in place of all that their sources, and those of ``sources``, had; returns the segment."""
        keys = chunks.select("source").distinct()
        if sources is not None:
            keys = keys.unionByName(sources.select("source")).distinct()
        number, folder = max(self.commits(), default=0) + 1, f"seg-{uuid.uuid4().hex}"
        self._write(number, folder, chunks, keys)
        self._commit(number, folder)
        return number

    def delete(self, source: str) -> int:
        gone = self.spark.createDataFrame([(source,)], "source string")
        return self.update(self.spark.createDataFrame([], f"{self.docs_schema.split(',')[0]}, source string, content string"), gone)

    def compact(self) -> int:
        """Writes what is live as one segment. Older folders stay for readers that have begun."""
        seen = self.commits()
        number, folder = max(seen, default=0) + 1, f"full-{uuid.uuid4().hex}"
        at, seg = f"{self.path}/{folder}", F.lit(number).alias("seg")
        dead = self._dead(seen)
        self._table("docs", self.docs_schema, seen).join(dead, ["seg", "id"], "left_anti").select("id", "source", seg).write.parquet(f"{at}/docs")
        self.spark.createDataFrame([], self.replaced_schema).write.parquet(f"{at}/replaced")
        live = self._table("postings", self.postings_schema, seen).select("term", "bucket", "seg", F.explode("found").alias("x")).select("term", "bucket", "seg", "x.*").join(dead, ["seg", "id"], "left_anti")
        live = live.select("*", self._block(self.spark.read.parquet(f"{at}/docs").count()))
        entry = live.groupBy("bucket", "term", "block").agg(F.max("tf").alias("max_tf"), F.array_sort(F.collect_list(F.struct("id", "tf"))).alias("found"))
        self._put(entry.select("term", "block", "max_tf", F.col("found.id").alias("ids"), F.col("found.tf").alias("tfs"), "bucket"), number, at)
        self._commit(number, folder)
        return number

    def _dead(self, commits: dict[int, str]) -> DataFrame:
        """(seg, id) of documents that a later segment replaces."""
        later = self._table("replaced", self.replaced_schema, commits).groupBy("source").agg(F.max("seg").alias("last"))
        docs = self._table("docs", self.docs_schema, commits)
        dead = docs.alias("d").join(later.alias("l"), F.expr("d.source <=> l.source AND d.seg < l.last")).select("d.seg", "d.id")
        return F.broadcast(dead) if dead.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else dead

    # --- search ---

    def _entries(self, questions: DataFrame, commits: dict[int, str]) -> tuple[DataFrame, DataFrame]:
        """Entries of the questions' buckets, and the questions' terms."""
        terms = question_terms(questions).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        named = terms.select("bucket", "term").distinct().limit(SCAN_TERMS + 1).collect()
        wanted = range(self.buckets) if len(named) > SCAN_TERMS else sorted({r.bucket for r in named})
        at = self._table("postings", self.postings_schema, commits).filter(F.col("bucket").isin(*wanted) if wanted else F.lit(False))
        return at if len(named) > SCAN_TERMS else at.filter(F.col("term").isin(*[r.term for r in named])), if_few(terms, questions)

    def _bounds(self, entries: DataFrame, terms: DataFrame) -> DataFrame:
        """(qid, seg, block, bound): what a document of the block can have at most."""
        return entries.select("term", "bucket", "seg", "block", "max_tf").join(terms, ["bucket", "term"]).groupBy("qid", "seg", "block").agg(F.sum("max_tf").alias("bound"))

    def _scores(self, entries: DataFrame, terms: DataFrame, units: DataFrame, dead: DataFrame) -> DataFrame:
        """(qid, id, n) of the live documents in blocks (qid, seg, block, least) that reach the least, all where it is null.

        Entries are dealt by question and block, so a document's terms are added up in its block's task.
        """
        found = entries.join(terms, ["bucket", "term"]).select("qid", "seg", "block", F.col("found.id").alias("id"), F.col("found.tf").cast("array<int>").alias("tf"))
        at = found.join(units, ["qid", "seg", "block"]).repartition("qid", "seg", "block").select("qid", "seg", "block", "least", F.explode(F.arrays_zip("id", "tf")).alias("x"))
        n = at.groupBy("qid", "seg", "block", F.col("x.id").alias("id")).agg(F.sum("x.tf").alias("n"), F.first("least").alias("least"))
        return n.filter(F.col("least").isNull() | (F.col("n") >= F.col("least"))).join(dead, ["seg", "id"], "left_anti").groupBy("qid", "id").agg(F.sum("n").alias("n"))

    def _shared(self, commits: dict[int, str], dead: DataFrame) -> bool:
        """Whether an id is live in more than one segment."""
        live = self._table("docs", self.docs_schema, commits).select("seg", "id").join(dead, ["seg", "id"], "left_anti")
        return len(commits) > 1 and not live.groupBy("id").agg(F.min("seg").alias("a"), F.max("seg").alias("b")).filter("a < b").isEmpty()

    def _plan(self, entries: DataFrame, terms: DataFrame, commits: dict[int, str], dead: DataFrame, k: int) -> DataFrame:
        bounds = self._bounds(entries, terms)
        if self._shared(commits, dead):
            return bounds.select("*", F.lit(None).cast("bigint").alias("least"), F.lit(True).alias("read"))
        best = top_k(bounds, ["qid"], [F.desc("bound"), F.col("seg"), F.col("block")], PROBE, "place")
        first = top_k(self._scores(entries, terms, best.select("qid", "seg", "block", F.lit(None).cast("bigint").alias("least")), dead), ["qid"], [F.desc("n"), F.col("id")], k)
        least = first.filter(F.col("rank") == k).select("qid", F.col("n").alias("least"))
        return bounds.join(least, "qid", "left").select("*", (F.col("bound") >= F.coalesce("least", F.lit(0))).alias("read"))

    def plan(self, questions: DataFrame, k: int, commits: dict[int, str] | None = None) -> DataFrame:
        """(qid, seg, block, bound, read): the blocks that hold a term of each question, and whether the search has to read them."""
        commits = self.commits() if commits is None else commits
        return self._plan(*self._entries(questions, commits), commits, self._dead(commits), k).drop("least")

    def top_k(self, questions: DataFrame, k: int) -> DataFrame:
        """(qid, id, score, rank) for questions (qid, query), as retrieval.keyword_top_k gives over all live chunks."""
        commits = self.commits()
        entries, terms = self._entries(questions, commits)
        dead = self._dead(commits)
        ensure_checkpoint_dir(entries)
        units = self._plan(entries, terms, commits, dead, k).filter("read").select("qid", "seg", "block", "least").checkpoint()
        units = F.broadcast(units) if units.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else units
        n = self._scores(entries, terms, units, dead)
        scored = n.select("qid", "id", F.round(F.col("n") * 0.1, 6).alias("score"))
        return top_k(scored, ["qid"], [F.desc("score"), F.col("id")], k)
