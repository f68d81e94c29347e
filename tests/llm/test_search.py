"""Lexical search, the prefix trie and embedding near-duplicates against brute-force versions, with nulls, ties, repeated rows and hot keys."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from sievewell.llm import forest, lexical, queries, trie
from sievewell.llm.common import table

FOLDER = "/root/testdata/sf0.001"

# --- lexical search ---

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, k):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    wanted = collections.defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = set()
    for item, ts in wanted.items():
        scores = []
        for i, c in counts:
            m = 50 + (50 * sum(c.values()) * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out |= {(item, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)}
    return out


DOCS = "doc_id bigint, text string, item_id string, rank int, score int, n int"


@pytest.mark.parametrize("pairs, impacts, piece", [(100_000, 1 << 20, 1 << 20), (40, 50, 30)])
def test_lexical(spark, monkeypatch, pairs, impacts, piece):
    for name, value in (("BLOCK_PAIRS", pairs), ("IMPACTS", impacts), ("PIECE", piece)):
        monkeypatch.setattr(lexical, name, value)
    rnd = random.Random(3)
    words = ["Ab", "ab", "ÄB", "äb", "x1", "zz", "日本", "q", "Q", "longer", "rare"]
    docs = [(i, rnd.choice([" ", "\n", "-", "\0", "_"]).join(rnd.choices(words, range(1, 12), k=rnd.randrange(40)))) for i in range(300)]
    docs += [(5, docs[5][1])] * 3 + [(None, "rare rare"), (None, "rare rare"), (1000, None), (1001, ""), (1002, "-- ..."), (1003, "common " * 30_000 + "rare")] + [(2000 + i, "tie ab") for i in range(60)]
    items = [(1, "ab AB äb"), (2, "日本 q, longer?"), (3, None), (4, "..."), (5, "unknown"), (6, "rare"), (6, "x1 rare"), (None, "tie"), (8, " ".join(words))] + [(100 + i, words[i % 11]) for i in range(20)]
    df = spark.createDataFrame([(*d, "x", 1, 1, 1) for d in docs], DOCS).repartition(7)
    it = spark.createDataFrame([(*i, 1, 1) for i in items], "item_id bigint, text string, doc_id int, rank int")
    got = [tuple(r) for r in lexical.rank(df, it, 50).collect()]
    want = ranked(docs, items, 50)
    assert len(got) == len(want) and set(got) == want
    assert lexical.rank(df.limit(0), it).count() == lexical.rank(df, it.limit(0)).count() == 0


def test_lexical_text_ids(spark):
    df = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "two"), ("d", "three")], "doc_id string, text string")
    it = spark.createDataFrame([("i", "ONE")], "item_id string, text string")
    assert [(r.item_id, r["rank"], r.doc_id) for r in lexical.rank(df, it).orderBy("rank").collect()] == [("i", 1, "a"), ("i", 2, "b"), ("i", 3, None)]


def test_radix_order():
    rng = np.random.default_rng(1)
    for bits in (5, 16, 17, 40):
        keys = rng.integers(0, 1 << bits, 5000).astype(np.uint64)
        assert (lexical.radix_order(keys, bits) == np.argsort(keys, kind="stable")).all()


# --- prefix trie ---


def nodes(rows):
    convs = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    for v in convs.values():
        v.sort(key=lambda x: x[:2])
    rebuilt = {}
    for c, v in convs.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        rebuilt[c] = [x[2:] for x in convs.get(base, [])[:h] + v[h:]]
    members = collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    children, leaves, saved = collections.Counter(k[:-1] for k in members if k), collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in children
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    ends = lambda k, m: hashlib.sha256(",".join(str(c) for c in m if len(rebuilt[c]) == len(k)).encode()).hexdigest()
    return collections.Counter((m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items())


CONV = "conv_id bigint, turn bigint, role string, text string, depth int, k1 int, family int, kind int"


@pytest.mark.parametrize("long, chunk, piece", [(2000, 50_000, 8000), (5, 7, 3), (6, 50_000, 2)])
def test_trie(spark, monkeypatch, long, chunk, piece):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "PIECE", piece)
    rnd = random.Random(5)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(201, 230), -5, -105, 10**15 + 3]:  # no base 200
        for t in rnd.sample(range(20), rnd.randrange(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "b", "é日", "", None, "same"])))
    rows += [(c, t, "user", f"copied {t}") for c in range(300, 360) for t in range(40)]  # a deep path with many members
    rows += [(700, None, "system", "first"), (700, 3, "user", "x"), (None, 1, "user", "no id"), (None, None, None, None)]
    df = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], CONV).repartition(5)
    assert collections.Counter(tuple(r) for r in trie.build(df, long).collect()) == nodes(rows)
    assert trie.build(df.limit(0), long).count() == 0
    assert trie.build(df.filter("conv_id is null"), long).count() == 0


def test_trie_ties(spark):
    """Turns that tie, repeated rows among them, have one order whatever the order of rows."""
    rows = [(100, 1, "user", x) for x in "abcabc"] + [(101, 1, "user", x) for x in "abcabc"]
    df = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], CONV)
    want = sorted(map(str, trie.build(df.coalesce(1)).collect()))
    assert want == sorted(map(str, trie.build(df.orderBy("text", ascending=False)).collect())) == sorted(map(str, trie.build(df, 3).collect()))


def test_trie_of_one_huge_conversation(spark):
    rows = [(100, 1, "user", "hello")] + [(101, t, "user", f"turn {t}") for t in range(300)]
    df = spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], CONV)
    assert collections.Counter(tuple(r) for r in trie.build(df, 100).collect()) == nodes(rows)


# --- embedding near-duplicates ---


def linked(vectors, cosine=0.9):
    """{place: (links, least id)}, comparing all pairs."""
    ok = [v is not None and None not in v and all(map(math.isfinite, v)) and any(v) for _, v in vectors]
    scaled = [np.array(v, float) / max(map(abs, v)) if o else None for (_, v), o in zip(vectors, ok, strict=True)]
    unit = [None if v is None else v / np.linalg.norm(v) for v in scaled]
    n, links = len(vectors), collections.Counter()
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for dim in {len(u) for u in unit if u is not None}:
        at = [i for i in range(n) if unit[i] is not None and len(unit[i]) == dim]
        m = np.array([unit[i] for i in at])
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= cosine - 1e-13, 1)), strict=True):
            links[at[a]] += 1
            links[at[b]] += 1
            x, y = find(at[a]), find(at[b])
            parent[max(x, y)] = min(x, y)
    least = {}
    for i in range(n):
        r = find(i)
        ids = [x for x in (least.get(r), vectors[i][0]) if x is not None]
        least[r] = min(ids) if ids else None
    return collections.Counter((vectors[i][0], links[i], least[find(i)], vectors[i][0] == least[find(i)]) for i in range(n))


def near(rng, base, cos):
    e = rng.standard_normal(len(base))
    e -= e @ base * base
    return cos * base + math.sqrt(1 - cos * cos) * e / np.linalg.norm(e)


def mixture(n, dim=32, seed=2):
    rng = np.random.default_rng(seed)
    centres = [x / np.linalg.norm(x) for x in rng.standard_normal((6, dim))]
    out = [near(rng, centres[i % 6], rng.uniform(0.3, 0.8)) for i in range(n)]
    out += [near(rng, centres[0], rng.uniform(0.93, 1)) for _ in range(n // 3)]  # a hot group, in which some are linked and some are not
    out += [near(rng, out[i], rng.uniform(0.88, 0.99)) for i in range(n // 4)]
    return [(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(out)]


VEC = "vec_id bigint, embedding array<float>, label int, node int, leaves int, rows int, id int, vec int"


def test_forest(spark):
    vectors = mixture(900)
    df = spark.createDataFrame([(*v, 1, 1, 1, 1, 1, 1) for v in vectors], VEC).repartition(5)
    got, want = forest.near_duplicates(df).collect(), linked(vectors)
    links = {i: n for i, n, _, _ in want}
    assert len(got) == len(vectors) and all(r.n_links <= links[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) >= 0.97 * sum(links.values()) > 0


@pytest.mark.parametrize("core", [8, 10**9])
def test_forest_blocks(spark, monkeypatch, core):
    """Leaves that nothing splits, compared block against block, find every pair once."""
    for name, value in (("LEAST", 10**9), ("LEAF", 10**9), ("BLOCK", 100), ("CORE_LEAST", core)):
        monkeypatch.setattr(forest, name, value)
    vectors = mixture(300)
    df = spark.createDataFrame([(*v, 1, 1, 1, 1, 1, 1) for v in vectors], VEC)
    assert collections.Counter(tuple(r) for r in forest.near_duplicates(df, trees=2).collect()) == linked(vectors)


def test_forest_rounds(spark, monkeypatch):
    """Leaves are split further, by plans of their own, without counting a pair twice."""
    monkeypatch.setattr(forest, "LEAF", 60)
    rng = np.random.default_rng(7)
    vectors = [(i, v / np.linalg.norm(v)) for i, v in enumerate(rng.standard_normal((1500, 16)))]
    vectors = [(i, v.tolist()) for i, v in vectors + [(1000 + i, near(rng, v, rng.uniform(0.9, 1))) for i, v in vectors[:300]]]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    links = {i: n for i, n, _, _ in linked(vectors)}
    got = forest.near_duplicates(df, trees=4).collect()
    assert all(r.n_links <= links[r.vec_id] for r in got) and sum(r.n_links for r in got) >= 0.95 * sum(links.values()) > 500


def test_forest_edges(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    nan, inf = float("nan"), float("inf")
    vectors = [(1, one), (2, one), (2, one), (3, [2 * x for x in one]), (4, [1e300 * x for x in one]), (5, [1e-300 * x for x in one]), (6, [-x for x in one]), (7, None), (8, []), (9, [0.0] * 4), (10, [1.0, None, 3.0, 4.0]), (11, [1.0, nan, 3.0, 4.0]), (12, [inf, 1.0, 1.0, 1.0]), (13, one[:3]), (14, one[:3]), (None, one), (None, [0.0, 0.0, 0.0, 1.0]), (None, None), (15, [0.0, 0.0, 0.0, -1.0]), (16, [-0.0, 0.0, -0.0, -1.0])]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    assert collections.Counter(tuple(r) for r in forest.near_duplicates(df).collect()) == linked(vectors)
    assert forest.near_duplicates(df.limit(0)).count() == 0
    named = spark.createDataFrame([(str(i), v) for i, v in vectors if i], "vec_id string, embedding array<double>")
    assert {(r.vec_id, r.component_id) for r in forest.near_duplicates(named).collect()} >= {("1", "1"), ("3", "1"), ("6", "6"), ("14", "13")}


def test_forest_threshold(spark):
    """A pair at the threshold is linked, one just under it is not."""
    a = [1.0, 0.0]
    vectors = [(1, a), (2, [0.9, math.sqrt(1 - 0.81)]), (3, [0.8999, -math.sqrt(1 - 0.8999**2)])]
    got = {r.vec_id: r.n_links for r in forest.near_duplicates(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_forest_hot_group(spark):
    """A third of all vectors are near copies of one: their links are counted without comparing them."""
    rng = np.random.default_rng(4)
    vectors = [(i, v) for i, v in mixture(600)] + [(10_000 + i, [float(x) for x in near(rng, np.eye(32)[0], rng.uniform(0.98, 1))]) for i in range(600)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = forest.near_duplicates(df).filter("vec_id >= 10000").collect()
    assert all(r.n_links >= 599 and r.component_id == 10_000 for r in got)


def test_forest_on_the_table(spark):
    got = queries.op13_embedding_dedup(spark, FOLDER)
    rows = [(r.vec_id, r.embedding) for r in table(spark, FOLDER, "embeddings").collect()]
    assert collections.Counter(tuple(r) for r in got.collect()) == linked(rows)
