"""A prefix trie over rebuilt conversations, merged family first.

1. Turns become two 64-bit hashes and a length each; texts are not shuffled. Conversations of one base id (the id without
   its last two digits) are a family. Each family is cogrouped with the first HEAD turns of its base, its conversations
   are rebuilt, and the family's own small trie is built from their prefixes, in numpy. A prefix is named by two running
   sums, modulo 2 ** 64, of stirred hashes of turn and depth.
2. Only the families' nodes, with their numbers of members, are shuffled and added up to the trie of all conversations.
3. Sums over subtrees take a round for each power of two up to the depth of the trie: a node that knows the sum over what
   lies less than 2 ** j below it hands that to its ancestor 2 ** j above. A node of one member is the top of a bare chain,
   which has one leaf and saves nothing, so only nodes of two members or more take part.
4. The ids that end at a node are dealt by ranges of (node, id), joined to pieces of PIECE ids in order, and the pieces
   are streamed through SHA-256.

A conversation of over LONG turns isn't held by its family: its turns are numbered by ranges, dealt in chunks of CHUNK turns, and
the chunks' sums give the offsets of their running sums, so that one conversation may hold most of all rows. Families without
these have a bounded number of rows, as a base id has at most 199 ids. Joins on nodes with very many children are salted.

Two different prefixes share their name with probability 2 ** -128 a pair.

Nulls and odd inputs: a null role or text is the empty one, null turns come first, and turns that tie are ordered by the
hashes of role and text. Rows without conv_id belong to no conversation and are left out. A conversation whose turns all
give way to those of an absent base is turnless and ends at the root. Repeated rows are turns of their own. An
empty table gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.topk import numbered, top_k
from .common import few, materialize, mix64, remove, spread_join

#: Conversations take their first turns from their base: as many as the crc32 of the id leaves, divided by this.
SHARED = 6
HEAD = SHARED - 1
LONG, CHUNK = 2000, 50_000
#: Ids that a piece of a node's list has, at most.
PIECE = 8000
BROADCAST_ROWS = 250_000

_FOUND = "kind int, k1 bigint, k2 bigint, p1 bigint, p2 bigint, depth bigint, chars bigint, n bigint, conv_id bigint"
_NODE, _END = 0, 1
_EMPTY = hashlib.sha256(b"").hexdigest()
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shared_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % SHARED


def _stir(h1: np.ndarray, h2: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a turn at a depth adds to the names of the prefixes that hold it."""
    d = depth.astype(np.uint64)
    return mix64(h1.view(np.uint64) + mix64(d * _A)), mix64(h2.view(np.uint64) + mix64(d * _B))


def _found(kind: int, **columns) -> pa.Table:
    names = ["k1", "k2", "p1", "p2", "depth", "chars", "n", "conv_id"]
    rows = len(columns["k1"])
    zeros = np.zeros(rows, np.int64)
    cols = [np.ascontiguousarray(columns.get(n, zeros)) for n in names]
    return pa.table([pa.array(np.full(rows, kind, np.int32)), *(pa.array(c.view(np.int64)) for c in cols)], ["kind", *names])


def _numbers(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(n).to_numpy().astype(np.int64) for n in names]


def family_nodes(own: pa.Table, heads: pa.Table) -> pa.Table:
    """The trie of one family's conversations, with its ends; of a long conversation only what it has from its base."""
    own = own.take(pc.sort_indices(own, [(n, "ascending") for n in ("conv_id", "turn", "h1", "h2")], null_placement="at_start"))
    heads = heads.sort_by([("pos", "ascending")])
    b1, b2, b_chars = _numbers(heads, "h1", "h2", "chars")
    (conv,) = _numbers(own, "conv_id")
    long = own.column("long").to_numpy(zero_copy_only=False)
    h1, h2, chars = (own.column(n).fill_null(0).to_numpy().astype(np.int64) for n in ("h1", "h2", "chars"))
    ids, first, rows = np.unique(conv, return_index=True, return_counts=True)
    parts, lengths = [], []
    for c, a, n in zip(ids.tolist(), first.tolist(), rows.tolist(), strict=True):
        h = shared_turns(c)
        a, b = (a, a) if long[a] else (min(a + h, a + n), a + n)
        parts.append([np.concatenate([x[:h], y[a:b]]) for x, y in ((b1, h1), (b2, h2), (b_chars, chars))])
        lengths.append(len(parts[-1][0]))
    s1, s2, s_chars = (np.concatenate(x) for x in zip(*parts, strict=True))
    lengths = np.array(lengths)
    start = np.cumsum(lengths) - lengths
    depth = np.arange(len(s1)) - np.repeat(start, lengths) + 1
    keys, parents = [], []
    for x in _stir(s1, s2, depth):
        total = np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64))
        before = np.repeat(total[start], lengths)
        keys.append(total[1:] - before)
        parents.append(total[:-1] - before)
    member = np.repeat(ids, lengths)
    order = np.lexsort((member, keys[1], keys[0]))
    k1, k2 = keys[0][order], keys[1][order]
    new = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))) if len(k1) else np.zeros(0, np.int64)
    at = order[new]
    nodes = _found(_NODE, k1=k1[new], k2=k2[new], p1=parents[0][at], p2=parents[1][at], depth=depth[at], chars=s_chars[at], n=np.diff(np.append(new, len(k1))), conv_id=member[at])
    one = np.zeros(1, np.int64)
    root = _found(_NODE, k1=one, k2=one, n=np.array([len(ids)]), conv_id=ids[:1])
    whole = ~long[first]
    last = (start + lengths - 1)[whole]
    turns = lengths[whole] > 0
    ends = _found(_END, k1=np.where(turns, keys[0][last], 0).astype(np.uint64) if len(k1) else np.zeros(len(last), np.int64), k2=np.where(turns, keys[1][last], 0).astype(np.uint64) if len(k1) else np.zeros(len(last), np.int64), conv_id=ids[whole])
    return pa.concat_tables([root, nodes, ends])


def _long_nodes(rows: DataFrame, heads: DataFrame, made: list[str]) -> DataFrame:
    """Nodes and ends of long conversations below what they have from their base; rows: conv_id, turn, h1, h2, chars."""

    def keep(df: DataFrame, label: str) -> DataFrame:
        table, path = materialize(df, label)
        made.append(path)
        return table

    # rows that repeat a turn differ in where they are read, so that ranges can part them
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("h1"), F.col("h2"), F.col("tie")]
    at = keep(numbered(rows.withColumn("tie", F.monotonically_increasing_id()), order), "long_turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = at.groupBy("conv_id").agg(F.min("number").alias("from"), F.count("*").alias("turns"))
    mine = heads.select("family", "pos", F.struct("pos", "h1", "h2").alias("head")).groupBy("family").agg(F.collect_list("head").alias("heads"))  # HEAD at most
    convs = convs.withColumn("family", F.col("conv_id") - F.col("conv_id") % 100).join(mine, "family", "left").withColumn("h", h)
    convs = convs.withColumn("heads", F.filter(F.coalesce("heads", F.array().cast("array<struct<pos:int,h1:bigint,h2:bigint>>")), lambda x: x.pos <= F.col("h")))
    convs = keep(convs, "long_convs")  # a row for LONG rows at least
    placed = at.join(few(convs.select("conv_id", "from", "h", F.size("heads").alias("shared")), BROADCAST_ROWS), "conv_id").filter(F.col("number") - F.col("from") >= F.col("h"))
    placed = keep(placed.select((F.col("number") / CHUNK).cast("long").alias("chunk"), "number", "conv_id", (F.col("number") - F.col("from") - F.col("h") + F.col("shared") + 1).alias("depth"), "h1", "h2", "chars"), "long_placed")

    def stirred(t: pa.Table):
        t = t.sort_by([("number", "ascending")])
        conv, depth, h1, h2, chars = _numbers(t, "conv_id", "depth", "h1", "h2", "chars")
        first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
        return conv, depth, chars, first, _stir(h1, h2, depth)

    def sums(t: pa.Table) -> pa.Table:
        conv, _, _, first, terms = stirred(t)
        return pa.table([pa.array(conv[first]), pa.array(np.full(len(first), t.column("chunk")[0].as_py())), *(pa.array(np.add.reduceat(x, first).view(np.int64)) for x in terms)], ["conv_id", "chunk", "s1", "s2"])

    def offsets(batches):
        conv, run = None, [0, 0]
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if r["conv_id"] != conv:
                    conv, run = r["conv_id"], [0, 0]
                    heads = r["heads"]
                    if heads:
                        pos = np.array([x["pos"] for x in heads])
                        terms = _stir(np.array([x["h1"] for x in heads], np.int64), np.array([x["h2"] for x in heads], np.int64), pos)
                        run = [int(x.sum(dtype=np.uint64)) for x in terms]
                before = list(run)
                run = [(x + (r[s] & (2**64 - 1))) % 2**64 for x, s in zip(run, ("s1", "s2"), strict=True)]
                r["s1"], r["s2"] = (x - 2**64 if x >= 2**63 else x for x in before)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], pa.int64()) for n in ("conv_id", "chunk", "s1", "s2")], ["conv_id", "chunk", "s1", "s2"])

    each = placed.groupBy("chunk").applyInArrow(sums, "conv_id bigint, chunk bigint, s1 bigint, s2 bigint").join(few(convs.select("conv_id", "heads"), BROADCAST_ROWS), "conv_id")
    before = each.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(offsets, "conv_id bigint, chunk bigint, s1 bigint, s2 bigint")  # a row for CHUNK rows

    def nodes(t: pa.Table, start: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _found(_NODE, k1=np.zeros(0, np.int64))
        conv, depth, chars, first, terms = stirred(t)
        known = {r["conv_id"]: (r["s1"], r["s2"]) for r in start.to_pylist()}
        rows = np.diff(np.append(first, len(conv)))
        keys, parents = [], []
        for i, x in enumerate(terms):
            total = np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64))
            off = np.array([known[c][i] for c in conv[first].tolist()], np.int64).view(np.uint64) - total[first]
            keys.append(total[1:] + np.repeat(off, rows))
            parents.append(total[:-1] + np.repeat(off, rows))
        return _found(_NODE, k1=keys[0], k2=keys[1], p1=parents[0], p2=parents[1], depth=depth, chars=chars, n=np.ones(len(conv), np.int64), conv_id=conv)

    below = keep(placed.groupBy("chunk").cogroup(before.groupBy("chunk")).applyInArrow(nodes, _FOUND), "long_nodes")
    last = below.groupBy("conv_id").agg(F.max(F.struct("depth", "k1", "k2")).alias("x"))
    return below.unionByName(last.select(F.lit(_END).alias("kind"), "x.k1", "x.k2", *[F.lit(0).cast("long").alias(n) for n in ("p1", "p2", "depth", "chars", "n")], "conv_id"))


def _subtrees(nodes: DataFrame, made: list[str]) -> DataFrame:
    """(k1, k2, leaves, saved) of the nodes with two members or more; nodes: k1, k2, p1, p2, depth, own_leaves, own_saved."""

    def keep(df: DataFrame, label: str) -> DataFrame:
        table, path = materialize(df, label)
        made.append(path)
        return table

    cur = keep(nodes.select("k1", "k2", F.col("p1").alias("a1"), F.col("p2").alias("a2"), "depth", F.col("own_leaves").alias("leaves"), F.col("own_saved").alias("saved")), "subtrees")
    deepest = cur.agg(F.max("depth")).first()[0] or 0
    step = 1
    while step <= deepest:  # a1, a2: the ancestor step above; sums are over what lies less than step below
        given = cur.filter(F.col("depth") >= step).groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        nxt = cur.join(given, ["k1", "k2"], "left").select("k1", "k2", "a1", "a2", "depth", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"))
        if 2 * step <= deepest:
            above = cur.filter(F.col("depth") >= step).select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
            deep = spread_join(nxt.filter(F.col("depth") >= 2 * step), keep(above, "above"), ["a1", "a2"], None, F.xxhash64("k1", "k2"), bound=BROADCAST_ROWS)
            done = nxt.filter(F.col("depth") < 2 * step).withColumns({"a1": F.lit(0).cast("long"), "a2": F.lit(0).cast("long")})
            nxt = deep.select("k1", "k2", F.col("b1").alias("a1"), F.col("b2").alias("a2"), "depth", "leaves", "saved").unionByName(done)
        cur, step = keep(nxt, "subtrees"), 2 * step
    return cur.select("k1", "k2", "leaves", "saved")


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the nodes that conversations end at."""

    def pieces(batches):
        key, ids = None, []
        for batch in batches:
            out = []
            for k1, k2, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key != (k1, k2) or len(ids) == PIECE:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = (k1, k2), []
                ids.append(c)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["k1", "k2", "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*key, ids[0], ",".join(map(str, ids))), types, strict=True)], ["k1", "k2", "first", "ids"])

    def digests(batches):
        key, sha = None, None
        for batch in batches:
            out = []
            for k1, k2, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if key != (k1, k2):
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], ["k1", "k2", "ends_sha256"])

    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    dealt = ends.select("k1", "k2", "conv_id").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    joined = dealt.mapInArrow(pieces, "k1 bigint, k2 bigint, first bigint, ids string")
    return joined.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(digests, "k1 bigint, k2 bigint, ends_sha256 string")


def build(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """A row for each node of the trie, see the module: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    long = max(long, HEAD)  # so that a long conversation has turns of its own
    made: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        table, path = materialize(df, label)
        made.append(path)
        return table

    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit("second"), text, role).alias("h2"), F.char_length(text).cast("long").alias("chars"))
    family = F.col("conv_id") - F.col("conv_id") % 100
    base = rows.filter(family == F.col("conv_id"))
    heads = keep(top_k(base, ["conv_id"], [F.asc_nulls_first("turn"), F.col("h1"), F.col("h2")], HEAD, "pos").select(F.col("conv_id").alias("family"), "pos", "h1", "h2", "chars"), "heads")
    many = keep(rows.groupBy("conv_id").count().filter(F.col("count") > long).select("conv_id"), "long")
    own = rows.join(few(many, BROADCAST_ROWS), "conv_id", "left_anti").withColumn("long", F.lit(False))
    stubs = many.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), *[F.lit(None).cast("long").alias(n) for n in ("h1", "h2", "chars")], F.lit(True).alias("long"))
    grouped = own.unionByName(stubs).withColumn("family", family).groupBy("family")
    found = grouped.cogroup(heads.groupBy("family")).applyInArrow(lambda a, b: family_nodes(a, b) if a.num_rows else _found(_NODE, k1=np.zeros(0, np.int64)), _FOUND)
    if not many.isEmpty():
        found = found.unionByName(_long_nodes(rows.join(few(many, BROADCAST_ROWS), "conv_id", "left_semi"), heads, made))
    found = keep(found, "families")

    first = lambda n: F.min(n).alias(n)
    nodes = keep(found.filter(F.col("kind") == _NODE).groupBy("k1", "k2").agg(first("p1"), first("p2"), first("depth"), first("chars"), first("conv_id"), F.sum("n").alias("n")), "nodes")
    below = nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"), F.sum((F.col("n") == 1).cast("long")).alias("single"))
    below = keep(below, "children")
    full = nodes.join(below, ["k1", "k2"], "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "single": F.coalesce("single", F.lit(0))})
    shared = full.filter("n > 1").select("k1", "k2", "p1", "p2", "depth", F.when(F.col("n_children") == 0, F.lit(1)).otherwise(F.col("single")).cast("long").alias("own_leaves"), ((F.col("n") - 1) * F.col("chars")).alias("own_saved"))
    full = full.join(_subtrees(shared, made), ["k1", "k2"], "left").join(_end_hashes(found.filter(F.col("kind") == _END)), ["k1", "k2"], "left")
    parents = keep(nodes.join(below, ["k1", "k2"]).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children"), "parents")
    named = spread_join(full.filter("depth > 0"), parents.withColumnRenamed("n_children", "rows"), ["p1", "p2"], "rows", F.xxhash64("k1", "k2"), bound=BROADCAST_ROWS)
    root = full.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = named.unionByName(root).select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))
    out, _ = materialize(out, "trie")
    remove(conversations.sparkSession, *made)
    return out
