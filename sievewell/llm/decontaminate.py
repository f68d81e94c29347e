"""Benchmark decontamination by spaced-seed hashing.

Texts and benchmark items are lower-cased runs of letters and digits. Fixed masks select token positions of a window
and ignore the others; their hashes over the items form a table of seeds (seed, item, position), and those over every
window of every document are joined with it by equal hash. A hit fixes a diagonal (position in the document less
position in the item). Along it the overlap is verified token by token, substitutions allowed: a document is
contaminated if any segment of a diagonal has MIN_TOKENS tokens, or covers ITEM_SHARE of an item of fewer, with
MIN_AGREE of them equal. Reported is the best segment (1 for an equal token, -2 for another) if it does, otherwise the
longest that does.

The masks miss nothing that the rule accepts: every segment that agrees enough holds one of 13 to 25 tokens that does
(cut it into pieces of such lengths; one of them has no larger share of substitutions), and each way to place the
substitutions in these leaves a window of one of the masks untouched, which a test shows by trying all. Items of 5 to
12 tokens have as seeds runs so short that no segment is without one. An item under LEAST_ITEM tokens is no sign of a
copy in a longer text; it contaminates documents that consist of it alone.

How it runs: the seeds are written as a table. Tasks test the windows of documents against a filter of the seeds'
hashes, a broadcast of at most 2 ** FILTER_BITS bits for any number of items; where it is too small, more windows
pass, and nothing is lost. Documents with such windows are written with their tokens, each text once a task, and the
windows are joined with the seeds (frequent ones are salted). Candidates meet their text, and their item's tokens, in a
task that streams past them. Documents are matched with the results by two 64-bit hashes of the text.

Nulls and odd inputs: null, empty and token-free texts and items have no hits. Repeated documents get a row each;
repeated items are all reported, null item ids as null. Empty tables: nothing is contaminated.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import array_sum, ddl, materialize, mix64, remove, spread_join, texts
from .runs import run_hashes

# 1 is a position that must be equal.
MASKS = ("111111", "1111011", "110100010011", "1000101000111")
MIN_TOKENS, MIN_AGREE, ITEM_SHARE = 13, 0.8, 0.9
#: Sums of 1 for an equal token and this for another are 0 or more where MIN_AGREE of the tokens are equal.
DISAGREE = -round(MIN_AGREE / (1 - MIN_AGREE))
MISMATCH = -2
#: Shortest item that is searched for inside of texts.
LEAST_ITEM = 5
#: Bits of the first test of a window, and least and most bits of the second.
FIRST_BITS, LEAST_BITS, FILTER_BITS = 21, 16, 28
#: Tokens that are hashed at once.
CHUNK = 1 << 16
#: Rows that are broadcast, at most, and bytes of item tokens.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 32 << 20
#: Texts that a task remembers to have sent.
SEEN = 200_000

_POWERS = mix64(np.arange(7001, 7001 + 64, dtype=np.uint64)) | np.uint64(1)


def tokens(batch: list[bytes | str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of tokens of each text, hashes of all): tokens are lower-cased runs of letters and digits."""
    counts, hashes = run_hashes(batch, "letters and digits")
    return counts, hashes[0]


def salt(mask: str) -> np.uint64:
    return np.uint64(zlib.crc32(mask.encode()) * 0x9E3779B97F4A7C15 % 2**64)


def masked(w: np.ndarray, masks: list[str]) -> list[np.ndarray]:
    """For each mask, the hashes of the selected tokens of each window as long as the mask."""
    spans = max(map(len, masks), default=0)
    used = {i for m in masks for i, c in enumerate(m) if c == "1"}
    times = {i: w * _POWERS[i] for i in range(spans) if i in used}
    out = []
    for m in masks:
        n = len(w) - len(m) + 1
        h = np.full(max(0, n), salt(m))
        if n > 0:
            for i, c in enumerate(m):
                if c == "1":
                    h += times[i][i : i + n]
        out.append(h)
    return out


def whole_hash(w: np.ndarray) -> int:
    """Seed of a text or item under LEAST_ITEM tokens, as a whole."""
    return (int((w * _POWERS[: len(w)]).sum(dtype=np.uint64)) + int(salt(f"whole{len(w)}"))) % 2**64


def least_length(n: int) -> int:
    """Tokens that a segment must have, for an item of n tokens."""
    return MIN_TOKENS if n >= MIN_TOKENS else math.ceil(ITEM_SHARE * n)


def masks_for(n: int) -> list[str]:
    """The masks; for items under MIN_TOKENS tokens a run of equal tokens that every segment to be found has; none under LEAST_ITEM."""
    if n >= MIN_TOKENS:
        return list(MASKS)
    if n < LEAST_ITEM:
        return []
    runs = []
    for length in range(least_length(n), n + 1):
        others = length // (1 - DISAGREE)  # at most
        runs.append(-(-(length - others) // (others + 1)))
    return ["1" * min(runs)]


def best_segment(equal: np.ndarray) -> tuple[int, int, int]:
    """Start, end and number of equal tokens of the segment with the highest sum (equal 1, other MISMATCH)."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, MISMATCH))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    start = int(np.flatnonzero(sums[: end + 1] == low[end])[-1])
    return start, end, int(equal[start:end].sum())


def verified_segment(equal: np.ndarray, least: int) -> tuple[int, int, int] | None:
    """Start, end and number of equal tokens of a segment of ``least`` tokens or more with MIN_AGREE of them equal, if there is any.

    The best segment if it is one, otherwise the longest (the first of equals).
    """
    if equal.sum() < MIN_AGREE * least:
        return None
    start, end, same = best_segment(equal)
    if end - start >= least and same >= MIN_AGREE * (end - start):
        return start, end, same
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 1, DISAGREE))])
    # The first place with a sum as low as here is where the running minimum gets there.
    first = np.searchsorted(-np.minimum.accumulate(sums), -sums)
    length = np.arange(len(sums)) - first
    end = int(np.argmax(length))
    start = int(first[end])
    return (start, end, int(equal[start:end].sum())) if end - start >= least else None


def verify(w: np.ndarray, x: np.ndarray, d: int) -> tuple[int, int, int] | None:
    """Start and end in the document, and equal tokens, of the overlap of document w and item x on diagonal d, if it counts."""
    if len(x) < LEAST_ITEM:
        return (0, len(x), len(x)) if d == 0 and len(w) == len(x) and (w == x).all() else None
    a, b = max(0, -d), min(len(x), len(w) - d)
    if b <= a:
        return None
    found = verified_segment(x[a:b] == w[a + d : b + d], least_length(len(x)))
    return (a + d + found[0], a + d + found[1], found[2]) if found else None


# --- the seeds --------------------------------------------------------------------------------------------------


def item_table(benchmark: DataFrame, item_id_col: str, item_text_col: str) -> DataFrame:
    """(item, item_id, n, tokens) of the items with tokens; ``item`` numbers them."""
    src = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))

    def run(batches):
        for batch in batches:
            counts, flat = tokens(texts(batch, "text"))
            w = np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int32()), pa.array([x.tobytes() for x in w], pa.binary())], ["item", "item_id", "n", "tokens"])

    return src.mapInArrow(run, f"item bigint, {ddl(src, 'item_id')}, n int, tokens binary").filter("n > 0")


def seed_table(items: DataFrame) -> DataFrame:
    """(seed, item, at): the hash of every window of every item that one of its masks selects."""

    def run(batches):
        for batch in batches:
            seeds, item, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for i, t in zip(batch.column(0).to_pylist(), texts(batch, "tokens"), strict=True):
                w = np.frombuffer(t, np.uint64)
                for h in masked(w, masks_for(len(w))) if len(w) >= LEAST_ITEM else [np.array([whole_hash(w)], np.uint64)]:
                    seeds.append(h)
                    item.append(np.full(len(h), i, np.int64))
                    at.append(np.arange(len(h), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds).view(np.int64)), pa.array(np.concatenate(item)), pa.array(np.concatenate(at))], ["seed", "item", "at"])

    return items.select("item", "tokens").mapInArrow(run, "seed bigint, item bigint, at int")


def _first_places(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FIRST_BITS)).astype(np.int64)


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << bits) - 1)
    return (h & low).astype(np.int64), ((h >> np.uint64(20)) & low).astype(np.int64)


def seed_filter(seeds: DataFrame, n: int) -> tuple[int, bytes, bytes]:
    """Bits of the second test, and the two tests' tables, packed; at most 2 ** FILTER_BITS bits whatever n, the number of seeds, is."""
    bits = min(FILTER_BITS, max(LEAST_BITS, math.ceil(math.log2(max(2, n))) + 5))

    def run(batches):
        first, second = np.zeros(1 << FIRST_BITS, bool), np.zeros(1 << bits, bool)
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            first[_first_places(h)] = True
            for p in _places(h, bits):
                second[p] = True
        return np.concatenate([np.packbits(first), np.packbits(second)])

    both = array_sum(seeds.select("seed"), run, np.uint8, combine=np.bitwise_or)
    return bits, both[: 1 << FIRST_BITS - 3].tobytes(), both[1 << FIRST_BITS - 3 :].tobytes()


class Filter:
    """The tests of a window's hash; no seed fails them."""

    def __init__(self, packed: tuple[int, bytes, bytes]):
        self.bits = packed[0]
        self.first = np.unpackbits(np.frombuffer(packed[1], np.uint8)).view(bool)
        self.second = np.frombuffer(packed[2], np.uint8)

    def passing(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be seeds'."""
        at = np.flatnonzero(self.first[_first_places(h)])
        ok = np.ones(len(at), np.uint8)
        for p in _places(h[at], self.bits):
            ok &= self.second[p >> 3] >> (7 - (p & 7)).astype(np.uint8)
        return at[ok & 1 == 1]


def window_hits(counts: np.ndarray, flat: np.ndarray, masks: list[str], test: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document's place, position in it, hash) of all windows that pass the test, in the order of documents.

    counts: numbers of tokens of the documents; flat: all tokens.
    """
    ends = np.cumsum(counts, dtype=np.int64)
    starts = ends - counts
    doc, at, seed = [], [], []
    longest = max(map(len, masks), default=1)
    for a in range(0, len(flat), CHUNK):
        part = flat[a : a + CHUNK + longest - 1]
        for m, h in zip(masks, masked(part, masks), strict=True):
            p = test.passing(h[:CHUNK])
            d = np.searchsorted(ends, p + a, "right")
            inside = p + a + len(m) <= ends[d]
            doc.append(d[inside])
            at.append(p[inside] + a)
            seed.append(h[p[inside]])
    short = np.flatnonzero((counts > 0) & (counts < LEAST_ITEM))
    doc.append(short)
    at.append(starts[short])
    seed.append(np.array([whole_hash(flat[starts[i] : ends[i]]) for i in short], np.uint64))
    doc, at, seed = np.concatenate(doc).astype(np.int64), np.concatenate(at).astype(np.int64), np.concatenate(seed)
    by = np.argsort(doc, kind="stable")
    return doc[by], at[by] - starts[doc[by]], seed[by]


# --- documents --------------------------------------------------------------------------------------------------


def _keys(text: Column) -> tuple[Column, Column]:
    """Two hashes that name a text."""
    return F.xxhash64(text).alias("__sw_k1"), F.xxhash64(F.lit("second"), text).alias("__sw_k2")


KEYS = ["__sw_k1", "__sw_k2"]


def overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(k1, k2, spans), a written table, for each distinct text with overlaps; spans: (item_id, start, end, equal), positions in tokens."""
    spark = docs.sparkSession
    made: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        table, path = materialize(df, label)
        made.append(path)
        return table

    items = keep(item_table(benchmark, item_id_col, item_text_col), "items")
    seeds = keep(seed_table(items), "seeds")
    n_seeds = seeds.count()
    shared = spark.sparkContext.broadcast(seed_filter(seeds, n_seeds) if n_seeds else (LEAST_BITS, bytes(1 << FIRST_BITS - 3), bytes(1 << LEAST_BITS - 3)))
    lengths = [r.n for r in items.select(F.least("n", F.lit(MIN_TOKENS)).alias("n")).distinct().collect()]  # MIN_TOKENS numbers at most
    masks = sorted({m for n in lengths for m in masks_for(n)})

    def hits(batches):
        test = Filter(shared.value)
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            keys = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            counts, flat = tokens(texts(batch, "text"))
            ends = np.cumsum(counts)
            doc, at, seed = window_hits(counts, flat, masks, test)
            found, first = np.unique(doc, return_index=True)
            last = np.append(first[1:], len(doc))[: len(found)]
            out: list[list] = [[], [], [], []]
            for d, a, b in zip(found.tolist(), first.tolist(), last.tolist(), strict=True):
                if keys[d] in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(keys[d])
                for o, v in zip(out, (d, flat[ends[d] - counts[d] : ends[d]].tobytes(), at[a:b].astype(np.int32), seed[a:b].view(np.int64)), strict=True):
                    o.append(v)
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.int64()))], ["row", *KEYS, "tokens", "at", "seed"])

    src = docs.select(F.monotonically_increasing_id().alias("row"), *_keys(F.col(text_col)), F.col(text_col).alias("text"))
    found = keep(src.mapInArrow(hits, "row bigint, __sw_k1 bigint, __sw_k2 bigint, tokens binary, at array<int>, seed array<bigint>"), "hits")
    shared.destroy()

    windows = found.select("row", *KEYS, F.explode(F.arrays_zip("at", "seed")).alias("w")).select("row", *KEYS, F.col("w.at").alias("doc_at"), F.col("w.seed").alias("seed"))
    often = windows.groupBy("seed").agg(F.count("*").alias("rows"))
    met = keep(seeds.join(often, "seed"), "met")
    candidates = spread_join(windows, met, "seed", "rows", F.xxhash64("row", "doc_at"), bound=BROADCAST_ROWS)
    candidates = keep(candidates.select(*KEYS, "item", (F.col("doc_at") - F.col("at")).alias("diagonal")).distinct(), "candidates")

    sized = items.agg(F.sum(F.octet_length("tokens")).alias("bytes"), F.count("*").alias("n")).first()
    small = (sized.bytes or 0) + 64 * sized.n <= BROADCAST_BYTES
    narrow = items.select("item", "tokens")
    with_items = candidates.join(F.broadcast(narrow), "item") if small else spread_join(candidates, narrow, "item", None, F.xxhash64(*KEYS, "diagonal"), bound=0)
    # one row stands for all that have its text
    chosen = found.select("row", *KEYS).join(candidates.select(*KEYS).distinct(), KEYS, "left_semi").groupBy(*KEYS).agg(F.min("row").alias("row"))
    texts_of = found.select("row", *KEYS, "tokens").join(chosen.select("row"), "row", "left_semi")
    rows = texts_of.select(*KEYS, "tokens", F.lit(-1).cast("bigint").alias("item"), F.lit(0).alias("diagonal")).unionByName(with_items.select(*KEYS, "tokens", "item", "diagonal"))
    rows = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, "item")

    def compare(batches):
        at, w = None, None
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            k1, k2, item, diagonal = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            for i, t in enumerate(texts(batch, "tokens")):
                if item[i] < 0:
                    at, w = (k1[i], k2[i]), np.frombuffer(t, np.uint64)
                elif at == (k1[i], k2[i]) and (seg := verify(w, np.frombuffer(t, np.uint64), diagonal[i])):
                    for o, v in zip(out, (k1[i], k2[i], item[i], *seg), strict=True):
                        o.append(v)
            kinds = [pa.int64()] * 3 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], [*KEYS, "item", "start", "end", "equal"])

    verified = rows.mapInArrow(compare, "__sw_k1 bigint, __sw_k2 bigint, item bigint, start int, end int, equal int")
    verified = keep(verified, "verified")
    ids = items.select("item", "item_id")
    named = spread_join(verified, ids, "item", None, F.xxhash64(*KEYS, "start"), bound=BROADCAST_ROWS)
    spans = named.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("item_id", "start", "end", "equal"))).alias("__sw_spans"))
    out, _ = materialize(spans, "spans")
    remove(spark, *made)
    return out


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (the id, by default), contaminated, n_overlaps, overlap_tokens, item_ids (sorted) and spans for every document."""
    keep = keep if keep is not None else [id_col]
    found = overlaps(docs, benchmark, text_col)
    rows = docs.select(*[F.col(c).alias(f"__in_{c}") for c in keep], *_keys(F.col(text_col)))
    size = found.agg(F.count("*").alias("n"), F.sum(F.size("__sw_spans")).alias("spans")).first()
    small = 128 * size.n + 48 * (size.spans or 0) <= BROADCAST_BYTES
    o = spread_join(rows, found, KEYS, None, F.xxhash64(*[f"__in_{c}" for c in keep]), "left", size.n if small else 0)
    spans = F.coalesce(F.col("__sw_spans"), F.expr("array()").cast(found.schema["__sw_spans"].dataType))
    return o.select(
        *[F.col(f"__in_{c}").alias(c) for c in keep],
        (F.size(spans) > 0).alias("contaminated"),
        F.size(spans).cast("long").alias("n_overlaps"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["end"] - s["start"])), F.lit(0)).cast("long").alias("overlap_tokens"),
        F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["item_id"]))).alias("item_ids"),
        spans.alias("spans"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones; all columns."""
    found = overlaps(docs, benchmark, text_col)
    k1, k2 = _keys(F.col(text_col))
    rows = docs.withColumns({"__sw_k1": k1, "__sw_k2": k2})
    clean = spread_join(rows, found.select(*KEYS), KEYS, None, F.monotonically_increasing_id(), "left_anti", BROADCAST_ROWS)
    return clean.select(*[F.col(c) for c in docs.columns])
