"""Entity graphs: merging, edges, components, communities, provenance, ranking, selection."""

from __future__ import annotations

import heapq
import warnings
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_name
from .retrieval import cosine
from .topk import numbered

#: Most edges of one connected component for greedy modularity, which takes a component in a task.
DRIVER_EDGES = 200_000
LABEL_ROUNDS = 20


def merge_entities(entities: DataFrame, order: str) -> DataFrame:
    """One row for each normalised name: the first name and type, the longest description (first of equals), all chunk ids sorted."""
    return (
        entities.withColumn("key", normal_name(F.col("name")))
        .groupBy("key")
        .agg(
            F.min_by(F.struct("name", "type"), F.col(order)).alias("f"),
            F.max_by("description", F.struct(F.length("description"), -F.col(order))).alias("description"),
            F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"),
        )
        .select("key", F.col("f.name").alias("name"), F.col("f.type").alias("type"), "description", "chunk_ids")
    )


def valid_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges both of whose ends are known names, ends normalised."""
    keys = entities.select("key")
    e = edges.withColumn("s", normal_name(F.col("source"))).withColumn("t", normal_name(F.col("target")))
    return e.join(keys.withColumnRenamed("key", "s"), "s", "left_semi").join(keys.withColumnRenamed("key", "t"), "t", "left_semi")


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component) of edges (a, b): the least node reachable. Large-star and small-star rounds, each cut by a checkpoint.

    Joins are hinted to be merge joins, as adaptive execution would else send sides that grow with the graph through the driver.
    """
    ensure_checkpoint_dir(edges)
    cur = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    last = None
    while True:
        state = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if last == (state.n, state.h) or not state.n:
            break
        last = (state.n, state.h)
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("m"))
        big = both.filter("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = big.groupBy("a").agg(F.min("b").alias("m"))
        joined = big.join(low.hint("merge"), "a")
        cur = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).filter("a <> b").distinct().checkpoint()
    out = cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    if nodes is not None:
        out = nodes.select("id").distinct().join(out.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    return out


def reach(anchor: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The anchor's rows, and those that ``step`` makes of the newest rows until it makes none (copies stay): a recursive UNION ALL of any size.

    Each level is checkpointed. Like any recursion it ends only if the steps do.
    """
    ensure_checkpoint_dir(anchor)
    level = out = anchor.checkpoint()
    while not (level := step(level).checkpoint()).isEmpty():
        out = out.unionByName(level)
    return out


def ensure_checkpoint_dir(df: DataFrame) -> None:
    """Takes the cluster's shared folder for checkpoints. Only a local session may do without; it gets a folder of its own."""
    import tempfile

    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and (sc.master.startswith("local-cluster") or not sc.master.startswith("local")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="sievewell-"))


def greedy_modularity(edges: list[tuple], resolution: float = 1.0, total: int | None = None) -> list[list]:
    """Communities by always joining the two that raise modularity most; the largest first, then by least member.

    Edges are undirected, without weights; repeated ones and loops count once and not at all. Joining two communities changes
    no gain in other components, so a component may be given alone, with the ``total`` of edges of the whole graph.
    """
    pairs = {(min(a, b), max(a, b)) for a, b in edges if a != b}
    if not pairs:
        return []
    m = total or len(pairs)
    near_enough = min(1e-15, 1 / (8 * m * m))  # below the difference of any two gains
    degree: dict = defaultdict(int)
    links: dict = defaultdict(dict)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
        links[a][b] = links[b][a] = 1
    names = sorted(degree)
    number = {x: i for i, x in enumerate(names)}
    near = {number[x]: {number[y]: w for y, w in links[x].items()} for x in names}
    weight = {number[x]: degree[x] for x in names}
    members = {number[x]: [x] for x in names}
    gain = lambda i, j: near[i][j] / m - resolution * weight[i] * weight[j] / (2 * m * m)
    heap = [(-gain(i, j), i, j) for i in near for j in near[i] if i < j]
    heapq.heapify(heap)
    full = 2 * len(heap) + 1000
    while heap:
        if len(heap) > full:  # entries of communities that are gone
            heap = [x for x in heap if x[1] in near and x[2] in near]
            heapq.heapify(heap)
            full = 2 * len(heap) + 1000
        g, i, j = heapq.heappop(heap)
        if i not in near or j not in near[i] or abs(-g - gain(i, j)) > near_enough:
            continue
        if -g <= 0:
            break
        for k, w in near.pop(j).items():
            if k == i:
                continue
            near[i][k] = near[k][i] = near[i].get(k, 0) + w
            del near[k][j]
        del near[i][j]
        weight[i] += weight.pop(j)
        members[i] += members.pop(j)
        for k in near[i]:
            heapq.heappush(heap, (-gain(min(i, k), max(i, k)), min(i, k), max(i, k)))
    return sorted((sorted(x) for x in members.values()), key=lambda c: (-len(c), c[0]))


def label_propagation(edges: DataFrame, rounds: int = LABEL_ROUNDS) -> DataFrame:
    """(id, community) for large graphs: nodes take the most frequent label (least of equals) of their neighbours and their own, until nothing moves.

    Warns if labels still move after ``rounds`` rounds (they may go back and forth for ever). Joins are hinted as in components().
    """
    ensure_checkpoint_dir(edges)
    both = edges.filter("a <> b").select("a", "b").unionByName(edges.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")).checkpoint()
    near = both.unionByName(labels.select(F.col("id").alias("a"), F.col("id").alias("b")))
    for _ in range(rounds):
        votes = near.join(labels.withColumnRenamed("id", "b").hint("merge"), "b").groupBy("a", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("v"))
        new = labels.join(best.hint("merge"), labels.id == best.a).select("id", F.col("v.community").alias("community"), F.col("community").alias("was")).checkpoint()
        labels = new.select("id", "community")
        if new.filter("community <> was").isEmpty():
            break
    else:
        warnings.warn(f"label propagation did not converge in {rounds} rounds", stacklevel=2)
    return labels


def communities(edges: DataFrame, method: str = "modularity") -> DataFrame:
    """(community, id) of edges (a, b), communities numbered from 0, the largest first.

    ``method`` is ``modularity`` (greedy, each connected component in a task, an error for a component beyond DRIVER_EDGES edges)
    or ``labels`` (label propagation, for graphs of any size). They give different communities, so the size never decides.
    """
    kind = edges.schema["a"].dataType.simpleString()
    if method not in ("modularity", "labels"):
        raise ValueError(f"unknown method {method!r}; known: modularity, labels")
    if method == "modularity":
        ensure_checkpoint_dir(edges)
        pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
        dealt = pairs.join(components(pairs).hint("merge"), pairs.a == F.col("id")).select("a", "b", "component").checkpoint()
        if not dealt.groupBy("component").count().filter(F.col("count") > DRIVER_EDGES).isEmpty():
            raise ValueError(f"a component of over {DRIVER_EDGES} edges is too large for method 'modularity'; choose 'labels'")
        total = pairs.count()

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            found = greedy_modularity(list(zip(pdf.a.tolist(), pdf.b.tolist(), strict=True)), total=total)
            return pd.DataFrame([(x, c[0]) for c in found for x in c], columns=["id", "community"])

        labels = dealt.groupBy("component").applyInPandas(run, f"id {kind}, community {kind}").checkpoint()
    else:
        labels = label_propagation(edges)
    sizes = labels.groupBy("community").agg(F.count("*").alias("n"))
    numbers = numbered(sizes, [F.desc("n"), F.col("community")])
    return labels.join(numbers.hint("merge"), "community").select(F.col("number").cast("int").alias("community"), "id")


def provenance(members: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(community, sources): sorted distinct sources of the chunks that name a community's members."""
    named = members.join(entities.select(F.col("key").alias("id"), F.explode("chunk_ids").alias("chunk_id")), "id")
    found = named.join(chunks.select(F.col("id").alias("chunk_id"), "source"), "chunk_id").select("community", "source").distinct()
    return found.groupBy("community").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def rebuild(comms: DataFrame, live: DataFrame) -> DataFrame:
    """Communities after deletions: those whose sources are all gone go too, others keep the live sources; no sources at all: kept."""
    kept = comms.select("id", F.explode("sources").alias("source")).join(live.select("source").distinct(), "source", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("source")).alias("__live"))
    out = comms.join(kept, "id", "left").filter((F.size("sources") == 0) | F.col("__live").isNotNull())
    return out.withColumn("sources", F.coalesce("__live", "sources")).drop("__live")


def is_live(sources: Column, live: list[str] | None) -> Column:
    """Whether sources are unknown or one of them is live."""
    return F.lit(True) if live is None else (F.size(sources) == 0) | F.arrays_overlap(sources, F.array(*[F.lit(x) for x in live]))


def rank_communities(comms: DataFrame, query: list[float], k: int = 8, live: list[str] | None = None) -> DataFrame:
    """The k communities most similar to the query; those without an embedding and dead ones are left out before the cut."""
    q = F.array(*[F.lit(float(x)) for x in query])
    usable = comms.filter((F.coalesce(F.size("embedding"), F.lit(0)) > 0) & is_live(F.col("sources"), live))
    return usable.withColumn("score", cosine(F.col("embedding"), q)).orderBy(F.desc("score"), "id").limit(k)


def select_by_size(comms: DataFrame, k: int = 8, least: int = 2, live: list[str] | None = None) -> DataFrame:
    """The k largest summarised communities of at least ``least`` members; all sizes if none is that large."""
    usable = comms.filter((F.coalesce("summary", F.lit("")) != "") & is_live(F.col("sources"), live)).withColumn("size", F.size("entity_names"))
    big = usable.filter(F.col("size") >= least)
    return (usable if big.isEmpty() else big).orderBy(F.desc("size"), "id").limit(k)


def local_search(entities: DataFrame, edges: DataFrame, query: str, k: int = 5, n_edges: int = 10) -> tuple[DataFrame, DataFrame]:
    """Entities that share most terms (over two letters) with the question, and the first edges that touch them."""
    import re

    terms = sorted({t for t in re.findall(r"\w+", query.lower()) if len(t) > 2})
    own = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("name"), F.lit(r"[\p{L}\p{N}_]+"), 0), lambda t: F.length(t) > 2))
    shared = F.size(F.array_intersect(own, F.array(*[F.lit(t) for t in terms]))) if terms else F.lit(0)
    hits = entities.withColumn("shared", shared).filter("shared > 0").orderBy(F.desc("shared"), "key").limit(k)
    names = F.broadcast(hits.select(normal_name(F.col("name")).alias("n")))
    near = edges.withColumn("s", normal_name(F.col("source"))).withColumn("t", normal_name(F.col("target")))
    touching = near.join(names, (F.col("s") == F.col("n")) | (F.col("t") == F.col("n")), "left_semi")
    return hits, touching.orderBy("source", "target").limit(n_edges)


def stale_sources(comms: DataFrame, live: DataFrame) -> DataFrame:
    return comms.select(F.explode("sources").alias("source")).distinct().join(live.select("source").distinct(), "source", "left_anti")
