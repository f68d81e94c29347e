"""Ranked lexical search by sort-based accumulation: impacts of items' terms, added up by sorting packed keys.

1. The items' distinct terms are taken in blocks of about BLOCK_PAIRS pairs (item, term), each held by the driver and sent
   to the tasks; whole items fall in a block by the hash of their id. The following is done for each block.
2. One pass over the texts writes for every document its length and the terms of the block that it has, with their
   occurrences. Texts are read once a block, and nothing else of them is kept.
3. The corpus counts (documents, terms, documents holding each term) are added up from that table in a tree of tasks.
4. Each task turns its documents' matches into arrays of item, document and impact, about IMPACTS at once, sorts the
   packed keys (item, document) by a radix sort of 16-bit digits, adds up equal keys and keeps each item's k best in a heap.
5. What the tasks keep is dealt by ranges of (item, hash of the document), so that an item's candidates spread over
   tasks, cut to k again in each of them, and ranked. Documents are never shuffled, and a task sends k rows an item at most.

Scores are 64-bit whole numbers; weights come from doubles, as floor(1000 * ln((2N + 2) / (2df + 1))). 50 * n * N must fit 64 bits.

Nulls and odd inputs: null or termless texts have no terms, count nowhere and are never found; an item without terms has
no rows. Every row of documents is a document of its own, also with a null or repeated id; equal scores are ordered by id,
null last. Rows of items that share an id are one item with the terms of all; a null id is an id. Long texts are cut in
pieces between terms. Empty tables give empty results. Ids may be of any type that has an order.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.topk import top_k
from .common import arrow_type, array_sum, ascii_lower, ddl, materialize, remove, texts

#: A term is a run of ASCII letters and digits and of all that is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 50
#: Pairs (item, term) in a block, about: the driver and each task hold them, some 10 MB.
BLOCK_PAIRS = 100_000
#: Impacts that are sorted at once, about, and bytes of text that are cut at once.
IMPACTS, PIECE = 1 << 20, 1 << 20

_FOLD = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
_POSTINGS = ["n", "terms", "counts"]


def pieces(text: bytes | None) -> list[bytes]:
    """The text, folded, in pieces of about PIECE bytes that end between terms."""
    if not text:
        return []
    t, out, a = text.translate(_FOLD), [], 0
    while len(t) - a > 2 * PIECE:
        b = t.find(b" ", a + PIECE)
        if b < 0:
            break
        out.append(t[a:b])
        a = b
    return [*out, t[a:]]


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts) for every row: its number of terms; places in the vocabulary and occurrences, packed."""

    def run(batches):
        for batch in batches:
            ns, terms, counts = [], [], []
            for t in texts(batch, "text"):
                n, found = 0, []
                for piece in pieces(t):
                    words = piece.split()
                    n += len(words)
                    at = np.fromiter(map(vocabulary.get, words, itertools.repeat(-1)), np.int32, len(words))
                    found.append(at[at >= 0])
                at, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                ns.append(n)
                terms.append(at.astype(np.int32).tobytes())
                counts.append(c.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", *_POSTINGS])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"{ddl(src, 'doc_id')}, n bigint, terms binary, counts binary")


def _statistics(table: DataFrame, size: int) -> np.ndarray:
    """Documents with a term, all terms, documents that hold each term of the vocabulary."""

    def run(batches):
        total = np.zeros(2 + size, np.int64)
        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False)
            total[0] += np.count_nonzero(n)
            total[1] += n.sum()
            total[2:] += np.bincount(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32), minlength=size)
        return total

    total = array_sum(table.select("n", "terms"), run, np.int64)
    return np.zeros(2 + size, np.int64) if total is None else total


def radix_order(keys: np.ndarray, bits: int) -> np.ndarray:
    """The order of unsigned keys below 2 ** bits, by stable counting sorts of 16-bit digits, the last digit first."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        digit = (keys >> np.uint64(shift)).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


class _Found:
    """A scored document; the smaller one is the one to give up first: the lower score, then the larger id, null being the largest."""

    __slots__ = ("id", "score")

    def __init__(self, score, id_):
        self.score, self.id = score, id_

    def __lt__(self, other):
        if self.score != other.score:
            return self.score < other.score
        return other.id is not None and (self.id is None or self.id > other.id)


class Best:
    """The k best documents of each item, in heaps."""

    def __init__(self, k: int):
        self.k, self.heaps = k, {}

    def least(self, item: int) -> int:
        heap = self.heaps.get(item, ())
        return heap[0].score if len(heap) == self.k else 1

    def add(self, item: int, score: int, id_) -> None:
        heap = self.heaps.setdefault(item, [])
        if len(heap) < self.k:
            heapq.heappush(heap, _Found(score, id_))
        else:
            heapq.heappushpop(heap, _Found(score, id_))

    def batches(self, id_type: pa.DataType):
        for item, heap in self.heaps.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(heap), pa.int32()), pa.array([x.id for x in heap], id_type), pa.array([x.score for x in heap], pa.int64())], ["item", "doc_id", "score"])


def accumulate(table: DataFrame, weights: np.ndarray, first: np.ndarray, items: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): what each task keeps. The items that hold term t are items[first[t] : first[t + 1]]."""
    id_type = arrow_type(table, "doc_id")
    n_items = int(items.max(initial=0)) + 1

    def run(batches):
        best = Best(k)
        for batch in batches:
            ids, n = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            terms = [np.frombuffer(x, np.int32) for x in batch.column(2).to_pylist()]
            counts = [np.frombuffer(x, np.int32) for x in batch.column(3).to_pylist()]
            impacts = np.cumsum([0, *(int((first[t + 1] - first[t]).sum()) for t in terms)])
            a = 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(impacts, impacts[a] + IMPACTS, "right")) - 1)
                rows = b - a
                t, tf = np.concatenate(terms[a:b]), np.concatenate(counts[a:b]).astype(np.int64)
                row = np.repeat(np.arange(rows), [len(x) for x in terms[a:b]])
                m = 100 - 50 + (50 * n[a:b] * n_docs) // n_terms if n_terms else n[a:b]
                impact = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
                held = first[t + 1] - first[t]
                place = np.repeat(first[t] - np.cumsum(held) + held, held) + np.arange(held.sum())
                key = items[place].astype(np.uint64) * np.uint64(rows) + np.repeat(row, held).astype(np.uint64)
                order = radix_order(key, (n_items * rows).bit_length())
                key = key[order]
                start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                score = np.add.reduceat(np.repeat(impact, held)[order], start) if len(key) else np.zeros(0, np.int64)
                item, at = np.divmod(key[start], np.uint64(rows))
                ends = np.flatnonzero(np.append(item[1:] != item[:-1], True)) + 1 if len(item) else []
                lo = 0
                for hi in ends:
                    i, mine = int(item[lo]), score[lo:hi]
                    good = np.flatnonzero(mine >= best.least(i))
                    if len(good) > k:
                        good = good[mine[good] >= np.partition(mine[good], len(good) - k)[len(good) - k]]
                    for j in good.tolist():
                        best.add(i, int(mine[j]), ids[a + int(at[lo + j])].as_py())
                    lo = hi
                a = b
        yield from best.batches(id_type)

    return table.mapInArrow(run, f"item int, {ddl(table, 'doc_id')}, score bigint")


def _select(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item within each task."""
    id_type = arrow_type(found, "doc_id")

    def run(batches):
        best = Best(k)
        for batch in batches:
            for item, id_, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best.add(item, score, id_)
        yield from best.batches(id_type)

    return found.mapInArrow(run, found.schema)


def rank(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item id, rank, document id, score): the k best documents of each item; see the module."""
    spark = docs.sparkSession
    pairs = items.select(F.col(item_col).alias("item_id"), F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(item_text_col)), F.lit(TERM), 0))).alias("term")).distinct()
    pairs, pairs_path = materialize(pairs, "item_terms")
    out, made = None, [pairs_path]
    n_blocks = max(1, -(-pairs.count() // BLOCK_PAIRS))
    for block in range(n_blocks):
        rows = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block).collect()
        ids = list(dict.fromkeys(r.item_id for r in rows))
        place, vocabulary = {x: i for i, x in enumerate(ids)}, {}
        at = np.array([vocabulary.setdefault(r.term.encode(), len(vocabulary)) for r in rows], np.int64)
        order = np.argsort(at, kind="stable")
        owners = np.array([place[r.item_id] for r in rows], np.int64)[order]
        first = np.searchsorted(at[order], np.arange(len(vocabulary) + 1))
        table, path = materialize(postings(docs, vocabulary, id_col, text_col), "postings")
        total = _statistics(table, len(vocabulary))
        n_docs, n_terms = int(total[0]), int(total[1])
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in total[2:].tolist()], np.int64)
        found, found_path = materialize(accumulate(table, weights, first, owners, n_docs, n_terms, k), "found")
        dealt = found.repartitionByRange("item", F.xxhash64("doc_id"))
        best = top_k(_select(dealt, k), ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"item int, {ddl(pairs, 'item_id')}")
        ranked, _ = materialize(best.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_col), "score"), "ranked")
        out = ranked if out is None else out.unionByName(ranked)
        made += [path, found_path]
    remove(spark, *made)
    return out
