"""Near-duplicate vectors by a random-projection tree forest, every link checked by its cosine in double precision.

1. Rows with equal vectors form a class, the node of all later steps. Vectors that are null, zero or hold null or
   non-finite components are nodes of nothing.
2. Cores: of a sample of SAMPLE classes (by hash, for any size of the table) those with CORE_LEAST neighbours or more
   within half the threshold's angle become centres, the most crowded first, at most SAMPLE / CORE_LEAST of them. Classes
   within that half angle of a centre belong to its core. Any two of a core are linked, by the triangle inequality of
   angles, so their links are counted and united without comparing them: a group of near copies may hold most of all rows.
3. Forest: each of TREES trees splits recursively. A split takes, of DIRECTIONS of the POOL random directions of its depth,
   the direction and the place between the SIDE and 1 - SIDE quantiles with fewest sampled points near it; classes within SPILL of the place go to both
   sides. A plan of splits is fitted to a sample (of the whole table for the first plan of each tree) and applied to all
   classes. Leaves over LEAF classes get a plan of their own, fitted to a sample of theirs, round by round, until no leaf can be split.
4. Leaves are compared whole, larger ones block against block; those of one core only need no comparison, and otherwise
   what isn't of a leaf's main core is compared with all of it. A pair counts in the first of the leaves that both are
   in, so it is counted once; pairs of one core are left out. No pairs are sent on: a task sends the number of links of each class, and for each
   component that it found a star of edges.
5. Counts are added up, and stars of leaves and cores united to connected components.

Links are exact; a pair that shares no leaf of any tree is lost. Splits keep dense groups whole where they can, so close pairs are rarely
lost; the tests measure the share of all pairs over the threshold that is found.
Classes are named by 64-bit hashes of the vector; two different vectors share one with probability 2**-64 a pair.

Nulls and odd inputs: rows whose vectors can't be compared have no links and are their own components. Vectors link only
with those of as many components. Repeated rows are links of each other. A null id is larger than any other, as a
component's smallest id too; null ids alone make a component of id null. A row is kept if its id is that of its
component. Empty tables give empty results. Ids may be of any type that has an order.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ddl, few, materialize, mix64, remove, spread_join, unit_hash
from .components import connected_components, least_labels

COSINE = 0.9
TREES, POOL, DIRECTIONS, DEPTH = 8, 256, 12, 7
#: Classes of a leaf that is split further, and classes of a block.
LEAF, BLOCK = 400, 800
#: Quantiles between which a split may be, and half the width of what goes to both sides, times the root of the dimension.
SIDE, SPILL = 0.3, 0.07
#: Share of a leaf's points that may be within CLOSE (times the root of the dimension) of a split: denser leaves are closer together than links are long.
STOP, CLOSE = 0.8, 0.1
#: Classes that plans and cores are fitted to, and those that a plan needs for a further split.
SAMPLE, LEAST = 4096, 24
CORE_LEAST = 8
ROUNDS = 8
SEED = 20240607
#: Rows that are broadcast, and plans of splits (1 kB each).
BROADCAST_ROWS, BROADCAST_PLANS = 250_000, 10_000
#: Pairs whose first common leaf is sought at once.
PAIRS = 20_000

_PLAN = np.dtype([("direction", "<i4"), ("at", "<f8")])  # direction -1: a leaf


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


@functools.lru_cache(64)
def directions(depth: int, dim: int) -> np.ndarray:
    """The random directions that splits at a depth choose from."""
    d = np.random.default_rng([SEED, depth, dim]).standard_normal((POOL, dim))
    return d / np.linalg.norm(d, axis=1)[:, None]


def fit(points: np.ndarray, name: int, first: int, size: int) -> np.ndarray | None:
    """A plan of DEPTH levels, as a heap of splits, fitted to unit vectors; ``name`` picks its directions, ``first`` is the depth of its top, ``size`` the number of all that the points are a sample of. None: it splits nothing."""
    plan = np.zeros((1 << DEPTH) - 1, _PLAN)
    plan["direction"] = -1
    dim, todo = points.shape[1], [(0, 0, np.arange(len(points)))]
    margin, close = SPILL / math.sqrt(dim), CLOSE / math.sqrt(dim)
    least = max(LEAST, LEAF * len(points) / max(size, 1))  # what LEAF classes are in the sample
    while todo:
        at, depth, rows = todo.pop()
        if depth == DEPTH or len(rows) <= least:
            continue
        pick = np.random.default_rng([SEED, abs(name), first + depth, at]).choice(POOL, DIRECTIONS, replace=False)
        dirs = directions(first + depth, dim)[pick]
        projected = np.sort(points[rows] @ dirs.T, axis=0)
        best = None
        for d in range(DIRECTIONS):
            p = projected[:, d]
            lo, hi = p[int(SIDE * (len(p) - 1))], p[math.ceil((1 - SIDE) * (len(p) - 1))]
            places = np.linspace(lo, hi, 17)
            near = np.searchsorted(p, places + close, "right") - np.searchsorted(p, places - close)
            i = int(np.argmin(near))
            if best is None or near[i] < best[0]:
                best = (int(near[i]), d, float(places[i]))
        crowd, d, place = best
        if crowd > STOP * len(rows):  # no gap to split at
            continue
        plan[at] = (pick[d], place)
        p = points[rows] @ dirs[d]
        for side, mask in ((2 * at + 1, p <= place + margin), (2 * at + 2, p >= place - margin)):
            todo.append((side, depth + 1, rows[mask]))
    return plan if plan["direction"][0] >= 0 else None


def descend(points: np.ndarray, plans: np.ndarray, which: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places in their plans): the leaves that each of the unit vectors comes to; ``which`` of the plans is a row's."""
    dim = points.shape[1]
    margin = SPILL / math.sqrt(dim)
    rows, at = np.arange(len(points)), np.zeros(len(points), np.int64)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for depth in range(DEPTH):
        split = plans[which[rows], at]
        leaf = split["direction"] < 0
        out.append((rows[leaf], at[leaf]))
        rows, at, split = rows[~leaf], at[~leaf], split[~leaf]
        if not len(rows):
            break
        p = np.einsum("ij,ij->i", points[rows], directions(first + depth, dim)[split["direction"]])
        left, right = p <= split["at"] + margin, p >= split["at"] - margin
        rows, at = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * at[left] + 1, 2 * at[right] + 2])
    else:
        out.append((rows, at))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def child(leaf: int | np.ndarray, at: np.ndarray) -> np.ndarray:
    """The names of leaves of plans that were made for ``leaf``."""
    return mix64(np.asarray(leaf).astype(np.int64).view(np.uint64) + mix64(at.astype(np.uint64) + np.uint64(1))).view(np.int64)


def root(tree: int, dim: int) -> int:
    return int(child(np.int64(tree * 1_000_003), np.array([dim]))[0])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors, of one dimension, as doubles."""
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim))


def by_dim(batch: pa.RecordBatch):
    """(places, unit vectors) of a batch's vectors of each dimension."""
    dims = batch.column(batch.schema.get_field_index("dim")).to_numpy(zero_copy_only=False)
    vec = batch.column(batch.schema.get_field_index("vec"))
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, matrix(vec.take(pa.array(rows)), dim)


def nodes_of(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, node, dim, vec) for every row; node is null where the vector can't be compared. Vectors of floats stay floats while they are moved."""
    single = vectors.schema[vec_col].dataType.elementType == T.FloatType()
    number, kind = (np.float32, pa.float32()) if single else (np.float64, pa.float64())

    def run(batches):
        for batch in batches:
            nodes, dims, vecs = [], [], []
            for v in batch.column(1):
                a = None
                if v.is_valid and not v.values.null_count and len(v.values):
                    a = v.values.to_numpy(zero_copy_only=False).astype(number)
                    with np.errstate(over="ignore", invalid="ignore"):
                        if not np.isfinite(a).all() or not a.any():
                            a = None
                        else:  # scaled by a power of two, which rounds nothing, so that squares neither overflow nor vanish
                            a = np.ldexp(a, -int(np.frexp(np.abs(a).max())[1])) + number(0)
                nodes.append(None if a is None else xxhash.xxh3_64_intdigest(a.tobytes()) - 2**63)
                dims.append(None if a is None else len(a))
                vecs.append(a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(dims, pa.int32()), pa.array(vecs, pa.list_(kind))], ["id", "node", "dim", "vec"])

    src = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    return src.mapInArrow(run, f"{ddl(src, 'id')}, node bigint, dim int, vec array<{'float' if single else 'double'}>")


def find_cores(points: np.ndarray, cosine: float) -> np.ndarray:
    """Centres of crowded balls of half the angle of ``cosine``."""
    half = math.sqrt((1 + cosine) / 2) + 1e-9
    near = [np.flatnonzero(points @ p >= half) for p in points]
    left, out = np.ones(len(points), bool), []
    counts = np.array([len(x) for x in near])
    while True:
        i = int(np.argmax(counts)) if len(counts) else 0
        if not len(counts) or counts[i] < CORE_LEAST:
            return np.array(out, np.int64)
        now = int(left[near[i]].sum())
        if now < counts[i]:  # the count is of before, lower it
            counts[i] = now
            continue
        out.append(i)
        left[near[i]] = False
        counts[i] = 0


def _sampled(classes: DataFrame, size: int) -> dict[int, np.ndarray]:
    """Unit vectors of SAMPLE classes or so, by the hash of their names, for each dimension."""
    rows = classes.filter(unit_hash(F.col("node"), F.lit("sample")) < min(1.0, SAMPLE / max(size, 1))).select("dim", "vec", "node").toArrow().sort_by("node")
    return {dim: points for batch in rows.combine_chunks().to_batches(max_chunksize=max(1, rows.num_rows)) for dim, _, points in by_dim(batch)}


def _assign(classes: DataFrame, sample: dict[int, np.ndarray], size: int, cosine: float, trees: int) -> DataFrame:
    """classes with their core (null: none) and leaves of each tree's first plan."""
    centres = {dim: p[find_cores(p, cosine)] for dim, p in sample.items()}
    plans = {dim: [fit(p, t, 0, size) for t in range(trees)] for dim, p in sample.items()}  # None: one leaf
    half = math.sqrt((1 + cosine) / 2) + 1e-9

    def run(batches):
        for batch in batches:
            core = np.full(batch.num_rows, -1, np.int64)
            rows_of, leaf_of = [], []
            for dim, rows, points in by_dim(batch):
                if len(centres.get(dim, ())):
                    cos = points @ centres[dim].T
                    at = cos.argmax(axis=1)
                    core[rows] = np.where(cos[np.arange(len(rows)), at] >= half, dim * SAMPLE + at, -1)
                for t in range(trees):
                    plan = plans[dim][t] if dim in plans else None
                    r, at = descend(points, plan[None], np.zeros(len(rows), np.int64), 0) if plan is not None else (np.arange(len(rows)), np.zeros(len(rows), np.int64))
                    rows_of.append(rows[r])
                    leaf_of.append(child(np.int64(root(t, dim)), at))
            r, leaf = np.concatenate(rows_of), np.concatenate(leaf_of)
            order = np.lexsort((leaf, r))
            counts = np.bincount(r, minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(leaf[order]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(core, mask=core < 0), lists], [*batch.schema.names, "core", "leaves"])

    return classes.select("node", "rows", "dim", "vec").mapInArrow(run, f"{ddl(classes, 'node', 'rows', 'dim', 'vec')}, core bigint, leaves array<bigint>")


def _split_further(placed: DataFrame, big: DataFrame, round_: int) -> DataFrame | None:
    """(node, leaf, new leaves) of the members of big leaves (leaf, m) that a further plan splits; None if none does."""
    members = spread_join(placed.select("node", "dim", "vec", F.explode("leaves").alias("leaf")), big.withColumnRenamed("m", "size"), "leaf", None, F.xxhash64("node"), bound=BROADCAST_ROWS)
    first = round_ * DEPTH

    def fitted(t: pa.Table) -> pa.Table:
        t = t.sort_by("node").combine_chunks()
        leaf, dim = t.column("leaf")[0].as_py(), t.column("dim")[0].as_py()
        plan = fit(matrix(t.column("vec").combine_chunks(), dim), leaf, first, t.column("size")[0].as_py())
        return pa.table([pa.array([leaf] * (plan is not None), pa.int64()), pa.array([plan.tobytes()] if plan is not None else [], pa.binary())], ["leaf", "plan"])

    sample = members.filter(unit_hash(F.col("node"), F.col("leaf")) < SAMPLE / F.col("size"))
    plans, path = materialize(sample.groupBy("leaf").applyInArrow(fitted, "leaf bigint, plan binary"), "plans")
    if plans.isEmpty():
        remove(placed.sparkSession, path)
        return None

    def moved(batches):
        for batch in batches:
            leaves = batch.column(batch.schema.get_field_index("leaf")).to_numpy(zero_copy_only=False)
            nodes = batch.column(batch.schema.get_field_index("node")).to_numpy(zero_copy_only=False)
            plan_col = batch.column(batch.schema.get_field_index("plan"))
            out = []
            for _, rows, points in by_dim(batch):
                known, at, which = np.unique(leaves[rows], return_index=True, return_inverse=True)
                stacked = np.stack([np.frombuffer(plan_col[int(rows[i])].as_py(), _PLAN) for i in at])
                r, place = descend(points, stacked, which, first)
                out.append((nodes[rows[r]], known[which[r]], child(known[which[r]], place)))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["node", "leaf", "to"])

    return spread_join(members.drop("size"), plans, "leaf", None, F.xxhash64("node"), bound=BROADCAST_PLANS).mapInArrow(moved, "node bigint, leaf bigint, to bigint")


def _first_common(x: np.ndarray, y: np.ndarray, leaf: int) -> np.ndarray:
    """Whether ``leaf`` is the least name that rows of two padded arrays of leaves have in common."""
    out = np.empty(len(x), bool)
    for a in range(0, len(x), PAIRS):
        p, q = x[a : a + PAIRS], y[a : a + PAIRS]
        earlier = np.zeros(len(p), bool)
        for i in range(p.shape[1]):
            earlier |= (p[:, i] < leaf) & (q == p[:, i, None]).any(axis=1)
        out[a : a + PAIRS] = ~earlier
    return out


class _Side:
    """Members of a leaf that a task holds."""

    def __init__(self, batch: pa.RecordBatch):
        get = lambda n: batch.column(batch.schema.get_field_index(n))
        self.node, self.rows = (get(n).to_numpy(zero_copy_only=False) for n in ("node", "rows"))
        self.core = get("core").fill_null(-1).to_numpy(zero_copy_only=False)
        self.far = get("far").to_numpy(zero_copy_only=False)
        leaves = get("leaves")
        lengths = pc.list_value_length(leaves).to_numpy(zero_copy_only=False)
        self.leaves = np.full((len(lengths), int(lengths.max(initial=1))), np.iinfo(np.int64).max)
        self.leaves[np.arange(self.leaves.shape[1]) < lengths[:, None]] = leaves.flatten().to_numpy(zero_copy_only=False)
        self.points = matrix(get("vec"), get("dim")[0].as_py())


def links_of(a: _Side, b: _Side | None, leaf: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (in a; in b, or in a as well if it is None) that are linked, that no other leaf counts and no core."""
    other = a if b is None else b
    x, y = np.nonzero(a.points @ other.points.T >= cosine - 1e-12)
    if b is None:
        ok = x < y
    else:  # far members against all: pairs of two far ones meet twice
        ok = (a.node[x] != b.node[y]) & (~b.far[y] | (a.node[x] < b.node[y]))
    ok &= (a.core[x] < 0) | (a.core[x] != other.core[y])
    x, y = x[ok], y[ok]
    ok = np.einsum("ij,ij->i", a.points[x], other.points[y]) >= cosine
    x, y = x[ok], y[ok]
    ok = _first_common(a.leaves[x], other.leaves[y], leaf)
    return x[ok], y[ok]


def compare(placed: DataFrame, cosine: float, keep) -> DataFrame:
    """(a, b, n): n > 0 says that class a has n linked rows more, n = 0 that a and b are of one component."""
    members = placed.select("node", "rows", "dim", "vec", "core", "leaves", F.explode("leaves").alias("leaf"))
    cores = members.groupBy("leaf", "core").agg(F.count("*").alias("m"))
    units = cores.groupBy("leaf").agg(F.sum("m").alias("m"), F.max(F.when(F.col("core").isNotNull(), F.struct("m", "core"))).alias("main"))
    blocks = lambda m: F.ceil(m / BLOCK).cast("int")
    # a leaf of one block is compared whole; in others the main core's members need no comparison with each other
    far = F.when(F.col("m") <= BLOCK, F.col("m")).otherwise(F.col("m") - F.coalesce("main.m", F.lit(0)))
    apart = F.col("m") - F.coalesce("main.m", F.lit(0))
    units = units.filter((F.col("m") > 1) & (apart > 0)).select("leaf", F.col("m").alias("size"), F.col("main.core").alias("main"), blocks(F.col("m")).alias("blocks"), blocks(far).alias("far_blocks"))
    units = keep(units, "leaves")
    rows = spread_join(members, units, "leaf", "size", F.xxhash64("node"), bound=BROADCAST_ROWS)
    rows = rows.withColumn("far", (F.col("blocks") == 1) | F.col("core").isNull() | F.col("main").isNull() | (F.col("core") != F.col("main")))
    mine = lambda n: F.pmod(F.xxhash64("node", "leaf"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cols = ("leaf", "node", "rows", "dim", "vec", "core", "leaves", "far", "blocks")
    whole = rows.filter("blocks = 1").select(*cols, F.lit(0).alias("f"), F.lit(0).alias("m"), F.lit(0).alias("role"))
    held = rows.filter("blocks > 1 and far").select(*cols, mine("far_blocks").alias("f"), every("blocks").alias("m"), F.lit(0).alias("role"))
    past = rows.filter("blocks > 1").select(*cols, every("far_blocks").alias("f"), mine("blocks").alias("m"), F.lit(1).alias("role"))
    dealt = whole.unionByName(held).unionByName(past).repartition("leaf", "f", "m").sortWithinPartitions("leaf", "f", "m", "role", "node")

    def found(a: _Side, b: _Side | None, leaf: int):
        x, y = links_of(a, b, leaf, cosine)
        node, rows = (a.node, a.rows) if b is None else (np.concatenate([a.node, b.node]), np.concatenate([a.rows, b.rows]))
        if b is not None:
            y = y + len(a.node)
        counts = np.bincount(x, rows[y], len(node)).astype(np.int64) + np.bincount(y, rows[x], len(node)).astype(np.int64)
        label = least_labels(len(node), x, y)
        some, edge = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(node)))
        return [np.concatenate([node[some], node[edge]]), np.concatenate([node[some], node[label[edge]]]), np.concatenate([counts[some], np.zeros(len(edge), np.int64)])]

    def run(batches):
        held: list[pa.RecordBatch] = []
        at = None

        def done():
            t = pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=10 * BLOCK + len(held) * 10_000)[0]
            role = t.column(t.schema.get_field_index("role")).to_numpy(zero_copy_only=False)
            n = int((role == 0).sum())
            a = _Side(t.slice(0, n)) if n else None
            out = None
            if t.column(t.schema.get_field_index("blocks"))[0].as_py() == 1:
                out = found(a, None, at[0])
            elif a and n < len(role):
                out = found(a, _Side(t.slice(n)), at[0])
            held.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("leaf", "f", "m")])
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            for a, b in zip(starts, np.append(starts[1:], len(keys)), strict=True):
                key = tuple(keys[a].tolist())
                if at is not None and key != at and (out := done()):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "n"])
                at = key
                held.append(batch.slice(a, b - a))
        if at is not None and (out := done()):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "n"])

    return keep(dealt.mapInArrow(run, "a bigint, b bigint, n bigint"), "links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """(id, n_links, component_id, kept) for every row; see the module."""
    made: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        table, path = materialize(df, label)
        made.append(path)
        return table

    rows = keep(nodes_of(vectors, id_col, vec_col), "vectors")
    classes = keep(rows.filter("node is not null").groupBy("node").agg(F.count("*").alias("rows"), F.min("id").alias("least"), F.first("dim").alias("dim"), F.first("vec").alias("vec")), "classes")
    size = classes.count()
    placed = keep(_assign(classes, _sampled(classes, size), size, cosine, trees), "placed")
    stuck: DataFrame | None = None
    for round_ in range(1, ROUNDS):
        big = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("m")).filter(F.col("m") > LEAF)
        if stuck is not None:
            big = big.join(few(stuck, BROADCAST_ROWS), "leaf", "left_anti")
        big = keep(big, "big")
        if big.isEmpty():
            break
        moved = _split_further(placed, big, round_)
        if moved is None:
            break
        moved = keep(moved, "moved")
        split = keep(moved.select("leaf").distinct(), "split")
        now_stuck = big.select("leaf").join(few(split, BROADCAST_ROWS), "leaf", "left_anti")
        stuck = keep(now_stuck if stuck is None else stuck.unionByName(now_stuck), "stuck")
        new = moved.groupBy("node").agg(F.collect_set("leaf").alias("left"), F.collect_set("to").alias("to"))  # a class's leaves: as many as trees, times what spills
        placed = keep(placed.join(new, "node", "left").withColumn("leaves", F.coalesce(F.array_sort(F.concat(F.array_except("leaves", "left"), "to")), "leaves")).drop("left", "to"), "placed")
    found = compare(placed, cosine, keep)
    cored = placed.filter("core is not null")
    cores = keep(cored.groupBy("core").agg(F.sum("rows").alias("all"), F.min("node").alias("hub")), "cores")  # SAMPLE / CORE_LEAST rows a dimension, at most
    in_core = cored.join(few(cores, BROADCAST_ROWS), "core")
    counts = found.filter("n > 0").select(F.col("a").alias("node"), "n").unionByName(in_core.select("node", (F.col("all") - F.col("rows")).alias("n")))
    counts = counts.groupBy("node").agg(F.sum("n").alias("links"))
    edges = found.filter("n = 0").select("a", "b").unionByName(in_core.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    rooted = keep(connected_components(edges, made).select(F.col("id").alias("node"), "root").join(classes.select("node", "least"), "node"), "rooted")
    comps = keep(rooted.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("rows")), "components")
    named = spread_join(rooted.select("node", "root"), comps, "root", "rows", F.xxhash64("node"), bound=BROADCAST_ROWS).select("node", "component", F.lit(True).alias("linked"))
    known = classes.select("node", "rows", "least").join(counts, "node", "left").join(named, "node", "left")
    known = keep(known.filter("rows > 1 or links is not null").select("node", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.when(F.col("linked"), F.col("component")).otherwise(F.col("least")).alias("component_id"), F.lit(True).alias("known"), "rows"), "known")
    worded = spread_join(rows.filter("node is not null").select("id", "node"), known, "node", "rows", F.xxhash64("id"), "left", BROADCAST_ROWS)
    out = worded.select("id", "n_links", "known", "component_id").unionByName(rows.filter("node is null").select("id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("boolean").alias("known"), F.lit(None).cast(rows.schema["id"].dataType).alias("component_id")))
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
    judged, _ = materialize(out, "near_vectors")
    remove(vectors.sparkSession, *made)
    return judged
