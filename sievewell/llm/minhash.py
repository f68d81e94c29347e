"""Near-duplicate documents by b-bit MinHash, with every link confirmed on full shingle sets.

1. Each document gets the set of its distinct five-word shingles (64-bit hashes), K minima, the low BITS of SKETCH of
   them packed into longs, and a key for each band of ROWS minima. Equal sets form a class, the node of all later steps.
2. Documents that share a band key are candidates. A bucket is not expanded into pairs: its members are first
   compared with one centre (a star), and the links found give components. Buckets that are one component then are
   done. Of the others only pairs between different components matter. In buckets of up to SMALL members these are
   joined, the estimate of step 3 being part of the join. In larger ones (groups of half similar texts) those outside
   the main component are compared with all members block against block, each task holding two blocks of bounded size
   and sending on confirmed links only. As a group meets in many buckets, buckets that share members are compared
   together as one cluster, unless that would copy more texts than bucket by bucket, as where clusters run together.
3. A candidate pair is dropped only if its similarity estimated by bit counts (corrected for the chance of equal low
   bits) is SIGMAS standard errors under the threshold. All others are confirmed on the full sets, which are made
   again from whole texts, those of the candidates only, beside the centre's, hot centres being salted.
4. Confirmed links give connected components, and each component keeps its smallest doc_id.

Joins by key, node or component broadcast the smaller side if it has BROADCAST_ROWS rows at most and otherwise salt
keys that many rows have, so no task gets all rows of a frequent key. Working tables are removed at the end.

A pair of similarity 0.75 shares none of the BANDS keys with probability (1 - 0.75**5)**60, under 1e-7.
Classes are named by 64-bit hashes of the sorted set; two different sets share one with probability 2**-64 a pair.

Nulls and odd inputs: a null, empty or wordless text has no shingle, links with nothing and is its own component; one
with under five words has its whole sequence as one shingle. Repeated rows share a class, so each gets the same
component. A null doc_id is larger than any other; a class or component of null ids only has a null component_id, and
such a row is kept. Ids may be of any type that has an order. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, ddl, few, materialize, mix64, remove, spread_join, texts
from .components import connected_components

SHINGLE = 5
ROWS, BANDS = 5, 60
K = ROWS * BANDS
BITS, SKETCH = 2, 256
#: A link has 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Centre's rows are copied once for so many members.
MEMBERS_A_SALT = 300
#: Standard errors of the estimate under the threshold at which a pair is dropped: under 4e-6 of links at the threshold.
SIGMAS = 4.5
LONGS = SKETCH * BITS // 64
SIG = [f"s{i}" for i in range(LONGS)]
#: Members of a bucket whose pairs are joined; larger buckets are compared by blocks.
SMALL = 64
#: Documents and shingles in a block, about.
BLOCK_DOCS, BLOCK_SHINGLES = 1000, 2_000_000
#: Buckets that share members are compared together if that copies at most so many times the texts of comparing them one by one.
TOGETHER = 1.0
#: Rows that are broadcast, at most: under 32 MB at up to 128 bytes each, with the overhead of a hash table.
BROADCAST_ROWS = 250_000
#: Classes whose sketch a task remembers to have sent.
SEEN = 200_000

_RNG = np.random.default_rng(20240501)
_MUL = (_RNG.integers(0, 2**32, K, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 2**32, K, dtype=np.uint32)[:, None]
_POWERS = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BAND_MUL = mix64(np.arange(101, 101 + ROWS, dtype=np.uint64)) | np.uint64(1)
_BAND_ADD = mix64(np.arange(1001, 1001 + BANDS, dtype=np.uint64))


def shingles(text: bytes | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; bytes.lower() and bytes.split() know ASCII only, as wanted."""
    words = text.lower().split() if text else []
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(w)
    if not n:
        return w
    m = min(n, size)
    h = np.zeros(n - m + 1, np.uint64)
    for i in range(m):
        h += w[i : n - m + 1 + i] * _POWERS[i]
    return np.unique(mix64(h + np.uint64(m)))


def minima(grams: np.ndarray) -> np.ndarray:
    """K minima of the set under as many hash functions."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    best = np.full(K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(best, (_MUL * x[i : i + 2048] + _ADD).min(axis=1), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    rows = best.reshape(BANDS, ROWS).astype(np.uint64)
    return mix64((mix64(rows + np.uint64(1)) * _BAND_MUL).sum(axis=1, dtype=np.uint64) + _BAND_ADD).view(np.int64)


def sketch(best: np.ndarray) -> np.ndarray:
    """The low bits of the first SKETCH minima (stirred), 32 to a long."""
    low = ((best[:SKETCH] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64).reshape(-1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def class_of(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - 2**63


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, bands, s0...) for every row; bands and sketch only once for each class in a task."""
    longs = pa.list_(pa.int64())

    def run(batches):
        hashes = WordHashes()
        seen: set[int] = set()
        for batch in batches:
            ns, nodes, bands = [], [], []
            sigs: list[list[int | None]] = [[] for _ in SIG]
            for t in texts(batch, "text"):
                g = shingles(t, hashes)
                node = class_of(g) if len(g) else None
                ns.append(len(g))
                nodes.append(node)
                if node is None or node in seen:
                    bands.append(None)
                    for s in sigs:
                        s.append(None)
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                best = minima(g)
                bands.append(band_keys(best))
                for s, x in zip(sigs, sketch(best).tolist(), strict=True):
                    s.append(x)
            columns = [batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, longs), *(pa.array(s, pa.int64()) for s in sigs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "node", "bands", *SIG])

    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"{ddl(src, 'doc_id')}, text_hash bigint, n_shingles bigint, node bigint, bands array<bigint>, {', '.join(f'{s} bigint' for s in SIG)}")


def estimate(a: list[Column], b: list[Column]) -> Column:
    """Similarity from packed low bits: the share of equal groups of bits, less the share that is equal by chance."""
    low, unequal = F.lit(0x5555555555555555).cast("bigint"), F.lit(0)
    for x, y in zip(a, b, strict=True):
        z = x.bitwiseXOR(y)
        unequal = unequal + (F.bit_count(z.bitwiseOR(F.shiftright(z, 1)).bitwiseAND(low)) if BITS == 2 else F.bit_count(z))
    chance = 2.0**-BITS
    return ((1 - unequal / SKETCH) - chance) / (1 - chance)


def least_estimate(percent: int = PERCENT) -> float:
    """SIGMAS standard errors under the threshold."""
    s, chance = percent / 100, 2.0**-BITS
    match = s + (1 - s) * chance
    return s - SIGMAS * (match * (1 - match) / SKETCH) ** 0.5 / (1 - chance)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """estimate() of one sketch (longs) with each row of others."""
    x = a.view(np.uint64) ^ b.view(np.uint64)
    if BITS == 2:
        x = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
    chance = 2.0**-BITS
    return ((1 - np.bitwise_count(x).sum(axis=1) / SKETCH) - chance) / (1 - chance)


def _plan(members: DataFrame, by: list[str]) -> DataFrame:
    """For each unit of comparison its main component (the largest), the numbers of blocks, and how many texts comparing it copies.

    members: ``by``, node, root, n.
    """
    roots = members.groupBy(*by, "root").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    units = roots.groupBy(*by).agg(F.max(F.struct("m", "root", "n")).alias("main"), F.sum("m").alias("m"), F.sum("n").alias("n"))
    blocks = lambda m, n: F.greatest(F.ceil(m / BLOCK_DOCS), F.ceil(n / BLOCK_SHINGLES), F.lit(1)).cast("int")
    far_m, far_n = F.col("m") - F.col("main.m"), F.col("n") - F.col("main.n")
    out = units.select(*by, F.col("main.root").alias("main"), "m", blocks(F.col("m"), F.col("n")).alias("blocks"), far_m.alias("far"), blocks(far_m, far_n).alias("far_blocks"))
    return out.filter("far > 0").withColumn("cost", F.col("far") * F.col("blocks") + F.col("m") * F.col("far_blocks"))


def compare_blocks(big: DataFrame, keys: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, made: list[str]) -> DataFrame:
    """Links (a, b) between different components of large buckets (key, node, root, n, s0...), found block against block; see the module."""

    def keep(df: DataFrame, label: str) -> DataFrame:
        table, path = materialize(df, label)
        made.append(path)
        return table

    low = keep(big.groupBy("key").agg(F.min("node").alias("lo"), F.count("*").alias("rows")), "low")
    joined = spread_join(big.select("key", "node"), low, "key", "rows", F.xxhash64("node"), bound=BROADCAST_ROWS)
    cluster = connected_components(joined.filter("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct(), made)
    cluster = cluster.select(F.col("id").alias("node"), F.col("root").alias("cluster"))
    nodes = keep(big.drop("key").distinct().join(cluster, "node"), "nodes")
    one_by_one = _plan(big, ["key"]).join(low.select("key", F.col("lo").alias("node")), "key").join(cluster, "node").drop("node")
    one_by_one = keep(one_by_one, "buckets_plan")
    apart = one_by_one.groupBy("cluster").agg(F.sum("cost").alias("apart"))
    together = keep(_plan(nodes, ["cluster"]).join(apart, "cluster").filter(F.col("cost") <= F.col("apart") * TOGETHER), "clusters_plan")
    singly = one_by_one.join(together.select("cluster"), "cluster", "left_anti")
    columns = ("main", "blocks", "far_blocks")
    as_clusters = spread_join(nodes, together.select("cluster", *columns, F.col("m").alias("rows")), "cluster", "rows", F.xxhash64("node"), bound=BROADCAST_ROWS).select(F.lit(0).alias("kind"), F.col("cluster").alias("unit"), "node", "root", *SIG, *columns)
    as_buckets = spread_join(big, keep(singly.select("key", *columns, F.col("m").alias("rows")), "singly"), "key", "rows", F.xxhash64("node"), bound=BROADCAST_ROWS).select(F.lit(1).alias("kind"), F.col("key").alias("unit"), "node", "root", *SIG, *columns)
    placed = as_clusters.unionByName(as_buckets).join(keys.select("node", "text_hash", "doc_id"), "node")
    placed = keep(placed.withColumn("in_main", F.col("root") == F.col("main")).drop("main"), "clusters")
    rows = _rows_of(few(placed, BROADCAST_ROWS), docs, id_col, text_col)
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ("kind", "unit", "node", "root", *SIG, "in_main", "text")
    far = rows.filter("not in_main").select(*cols, block("far_blocks").alias("f"), every("blocks").alias("m"), F.lit(0).alias("role"))
    near = rows.select(*cols, every("far_blocks").alias("f"), block("blocks").alias("m"), F.lit(1).alias("role"))
    dealt = far.unionByName(near).repartition("kind", "unit", "f", "m").sortWithinPartitions("kind", "unit", "f", "m", "role", "node")
    least = least_estimate(percent)

    def compare(batches):
        hashes = WordHashes()
        at: tuple | None = None
        held: list[tuple] = []
        sigs = np.zeros((0, LONGS), np.int64)
        linked: set[tuple[int, int]] = set()
        for batch in batches:
            a, b = [], []
            names = batch.schema.names
            col = {n: batch.column(names.index(n)).to_pylist() for n in ("kind", "unit", "f", "m", "node", "root", "in_main", "role")}
            mine_sigs = np.column_stack([batch.column(names.index(n)).to_numpy(zero_copy_only=False) for n in SIG])
            for i, t in enumerate(texts(batch, "text")):
                key, node, root = (col["kind"][i], col["unit"][i], col["f"][i], col["m"][i]), col["node"][i], col["root"][i]
                if key != at:
                    at, held, linked, sigs = key, [], set(), sigs[:0]
                if col["role"][i] == 0:
                    held.append((node, root, shingles(t, hashes), mine_sigs[i]))
                    continue
                if not held:
                    continue
                if len(sigs) != len(held):
                    sigs = np.array([h[3] for h in held], np.int64)
                est = estimates(mine_sigs[i], sigs)
                mine = None
                for k in np.flatnonzero(est >= least)[np.argsort(-est[est >= least], kind="stable")].tolist():
                    other, its, grams, _ = held[k]
                    if its == root or (not col["in_main"][i] and node <= other) or (other, root) in linked or (its, root) in linked:
                        continue
                    mine = shingles(t, hashes) if mine is None else mine
                    if similar(grams, mine, percent):
                        linked.add((other, root))
                        linked.add((its, root))
                        a.append(other)
                        b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return keep(dealt.mapInArrow(compare, "a bigint, b bigint").distinct(), "links")


def _rows_of(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """nodes, which name a row each by text_hash and doc_id, with that row's text."""
    t = docs.select(F.col(id_col).alias("row_id"), F.xxhash64(text_col).alias("row_hash"), F.col(text_col).alias("text"))
    return t.join(nodes, (F.col("row_hash") == F.col("text_hash")) & F.col("row_id").eqNullSafe(F.col("doc_id")))


def confirm(pairs: DataFrame, keys: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int, made: list[str]) -> DataFrame:
    """Of candidates (a: centre, b: member; a written table), those whose full sets are similar enough.

    ``keys`` names a row of docs (doc_id, text_hash) for each node. These rows' texts, and no others, are shuffled,
    beside the centres that they belong to. In a task the rows are sorted by centre, the centre's set first, and
    stream past it.
    """

    def keep(df: DataFrame, label: str) -> DataFrame:
        table, path = materialize(df, label)
        made.append(path)
        return table

    sizes = keep(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS_A_SALT).cast("int").alias("salts")), "centres")
    hot = few(sizes.filter("salts > 1"), BROADCAST_ROWS)
    salted = pairs.join(hot, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"), F.lit(0)))
    members = salted.select(F.col("b").alias("node"), F.col("a").alias("centre"), "salt", F.lit(1).alias("is_member"))
    centres = sizes.select(F.col("a").alias("node"), F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("is_member"))
    sides = keep(members.unionByName(centres).join(keys.select("node", "text_hash", "doc_id"), "node"), "sides")

    def compare(batches):
        hashes = WordHashes()
        centre, grams = None, None
        for batch in batches:
            a, b = [], []
            for c, m, is_member, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts(batch, "text"), strict=True):
                if not is_member:
                    if centre != c:
                        centre, grams = c, shingles(t, hashes)
                elif centre == c and similar(grams, shingles(t, hashes), percent):
                    a.append(c)
                    b.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = _rows_of(few(sides, BROADCAST_ROWS), docs, id_col, text_col).select("centre", "node", "is_member", "text", "salt")
    rows = rows.repartition("centre", "salt").sortWithinPartitions("centre", "salt", "is_member")
    return keep(rows.mapInArrow(compare, "a bigint, b bigint").distinct(), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of docs; see the module."""
    return _judge(docs, id_col, text_col, percent).select(id_col, "n_shingles", "component_id", "kept")


def _judge(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(id, text_hash, n_shingles, component_id, kept, root) for every row of docs, a written table; root is null for wordless texts."""
    made: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        table, path = materialize(df, label)
        made.append(path)
        return table

    signed = keep(signatures(docs, id_col, text_col), "signatures")
    classes = signed.filter("node is not null").groupBy("node").agg(F.min(F.struct("text_hash", "doc_id")).alias("r"), F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    keys = keep(classes.select("node", "r.text_hash", "r.doc_id", "least", "rows"), "keys")
    first = signed.filter(F.col("bands").isNotNull())
    entries = first.select("node", F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("rows")).filter("lo < hi")
    shared = keep(shared.select("key", "lo", "rows"), "shared")
    multi = keep(spread_join(entries, shared, "key", "rows", F.xxhash64("node"), bound=BROADCAST_ROWS).select("key", "node", "lo").distinct(), "buckets")
    sigs = keep(first.select("node", F.col("n_shingles").alias("n"), *SIG).join(multi.select("node").distinct(), "node", "left_semi").distinct(), "sketches")
    likely = lambda x, y: estimate([F.col(f"{x}{s}") for s in SIG], [F.col(f"{y}{s}") for s in SIG]) >= least_estimate(percent)

    rays = keep(multi.filter("node <> lo").select(F.col("lo").alias("a"), "node").distinct(), "rays")
    centres = rays.groupBy("a").agg(F.count("*").alias("rows")).join(sigs.select(F.col("node").alias("a"), *[F.col(s).alias(f"a_{s}") for s in SIG]), "a")
    stars = spread_join(rays.join(sigs, "node"), keep(centres, "centres"), "a", "rows", F.xxhash64("node"), bound=BROADCAST_ROWS).filter(likely("", "a_"))
    links = confirm(keep(stars.select("a", F.col("node").alias("b")), "stars"), keys, docs, id_col, text_col, percent, made)
    rooted = connected_components(links, made).select(F.col("id").alias("node"), "root")

    placed = multi.select("key", "node").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
    apart = keep(sizes.groupBy("key").agg(F.sum("m").alias("rows"), F.count("*").alias("roots")).filter("roots > 1").select("key", "rows", F.col("rows").alias("members")), "apart")
    found = None
    if not apart.isEmpty():
        rest = spread_join(placed, apart, "key", "rows", F.xxhash64("node"), bound=BROADCAST_ROWS).join(sigs, "node")
        rest = keep(rest, "rest")
        small, big = rest.filter(F.col("members") <= SMALL), rest.filter(F.col("members") > SMALL).drop("members")
        other = small.select(F.col("key").alias("key_b"), F.col("node").alias("b"), F.col("root").alias("root_b"), *[F.col(s).alias(f"b_{s}") for s in SIG])
        tried = small.withColumnRenamed("node", "a").join(other, (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & (F.col("root") != F.col("root_b")) & likely("", "b_"))
        found = confirm(keep(tried.select("a", "b").distinct(), "tried"), keys, docs, id_col, text_col, percent, made)
        if not big.isEmpty():
            found = found.unionByName(compare_blocks(big, keys, docs, id_col, text_col, percent, made))
        if not found.isEmpty():
            rooted = connected_components(links.unionByName(found), made).select(F.col("id").alias("node"), "root")

    linked = rooted.join(keys.select("node", "least"), "node")
    comps = keep(linked.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("rows")), "components")
    named = spread_join(linked, comps, "root", "rows", F.xxhash64("node"), bound=BROADCAST_ROWS).select("node", "root", "component")
    # classes of one row without links need no join: they are their own components
    groups = keys.select("node", "least", "rows").join(named, "node", "left").filter("rows > 1 or root is not null")
    groups = keep(groups.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("component", "least").alias("component"), F.lit(True).alias("grouped"), "rows"), "groups")
    worded = spread_join(signed.filter("node is not null").select("doc_id", "text_hash", "n_shingles", "node"), groups, "node", "rows", F.xxhash64("doc_id", "text_hash"), "left", BROADCAST_ROWS)
    out = worded.select("doc_id", "text_hash", "n_shingles", F.coalesce("root", "node").alias("root"), F.when(F.col("grouped"), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    wordless = signed.filter("node is null").select("doc_id", "text_hash", "n_shingles", F.lit(None).cast("bigint").alias("root"), F.col("doc_id").alias("component_id"))
    out = out.unionByName(wordless).select(F.col("doc_id").alias(id_col), "text_hash", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "root")
    judged, _ = materialize(out, "judged")
    remove(docs.sparkSession, *made)
    return judged


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, that of its smallest id, and all rows without words.

    Of rows of a component that share the smallest id but not the text one stays; so it does of rows that repeat both.
    """
    judged = _judge(docs, id_col, text_col, percent)
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.col("text_hash").alias("hash"))
    worded = judged.filter("root is not null")
    best = worded.groupBy("root").agg(F.min(order).alias("best")).select("best.id", "best.hash", F.lit(True).alias("one"))
    empty = judged.filter("root is null").select(F.col(id_col).alias("id"), F.col("text_hash").alias("hash"), F.lit(False).alias("one")).distinct()
    chosen = best.unionByName(empty).select(F.col("id").alias("__sw_id"), F.col("hash").alias("__sw_hash"), F.col("one").alias("__sw_one"))
    chosen, _ = materialize(chosen, "chosen")
    keyed = docs.withColumn("__sw_text_hash", F.xxhash64(text_col))
    here = keyed.join(few(chosen, BROADCAST_ROWS), F.col(id_col).eqNullSafe(F.col("__sw_id")) & (F.col("__sw_text_hash") == F.col("__sw_hash")))
    # rows that repeat id and text; those of texts that are not kept do no harm here
    if not worded.groupBy(id_col, "text_hash").count().filter("count > 1").isEmpty():
        here = here.filter("__sw_one").dropDuplicates(["__sw_id", "__sw_hash"]).unionByName(here.filter(~F.col("__sw_one")))
    return here.select(*[F.col(c) for c in docs.columns])
