"""Queries and operators against brute-force versions, exact round trips and held-out labels."""

import collections
import io
import itertools
import random
import re
import struct
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievewell.llm import common, components, decontaminate, language, minhash, mixing, quality_rules, queries, runs, sharding, toxicity, warc

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(name):
    return duckdb.sql(f"SELECT * FROM '{FOLDER}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    c = duck.execute(queries.ORACLE_SQL[name])
    at = [[x[0] for x in c.description].index(x) for x in cols]
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in c.fetchall())


# --- near-duplicates ---


def words_set(t):
    w = WORD.findall(t.lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected_components(texts):
    sets, parent = {i: words_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def family(size, edits, seed=1):
    """Copies of a text with up to ``edits`` words replaced: many half-similar ones, around one component."""
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    out = {}
    for i in range(size):
        w = list(base)
        for _ in range(rnd.randrange(edits)):
            w[rnd.randrange(150)] = f"x{rnd.randrange(10**6)}"
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize(("small", "together", "broadcast"), [(10**9, 1.0, 250_000), (1, 1e9, 250_000), (1, 0.0, 250_000), (20, 1.0, 0)])
def test_half_similar_family(spark, small, together, broadcast, monkeypatch):
    """By joined pairs, by blocks of clusters, by blocks of buckets, and with salted joins in place of broadcasts."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "TOGETHER", together)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(minhash, "BLOCK_DOCS", 40)
    monkeypatch.setattr(common, "ROWS_A_SALT", 30)
    texts = family(150, 12)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == expected_components(texts)


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_spread_join(spark, how, monkeypatch):
    monkeypatch.setattr(common, "ROWS_A_SALT", 7)
    left = spark.createDataFrame([(i % 3 if i < 60 else i, i) for i in range(70)], "k int, x int")
    right = spark.createDataFrame([(0, "a"), (2, "b"), (2, "c"), (65, "d"), (99, "e")], "k int, y string")
    key = lambda df: sorted(map(repr, df.collect()))
    sizes = right.join(left.groupBy("k").agg(F.count("*").alias("n")), "k")
    plain = key(left.join(right, "k", how))
    assert key(common.spread_join(left, right, "k", None, F.xxhash64("x"), how, bound=0)) == key(common.spread_join(left, right, ["k"], None, F.xxhash64("x"), how)) == plain
    if how == "inner":
        assert key(common.spread_join(left, sizes, "k", "n", F.xxhash64("x"), how, bound=0)) == plain


def test_estimate():
    rnd = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.75, 0.9):
        both = rnd.integers(0, 2**63, int(1000 * share)).astype(np.uint64)
        a, b = (np.unique(np.concatenate([both, rnd.integers(0, 2**63, (1000 - len(both)) // 2).astype(np.uint64)])) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = minhash.estimates(minhash.sketch(minhash.minima(a)), minhash.sketch(minhash.minima(b))[None, :])[0]
        assert abs(est - true) < 0.15
    assert minhash.least_estimate() < 0.65


def test_shingles_split_on_ascii_space_only():
    h = minhash.WordHashes()
    assert len(minhash.shingles("a b c \x1f d E".encode(), h)) == 1
    assert (minhash.shingles("A b c D e".encode(), h) == minhash.shingles("a\tb\n\x0bc  d e ".encode(), h)).all()
    assert not (minhash.shingles("É b c d e".encode(), h) == minhash.shingles("é b c d e".encode(), h)).any()


@pytest.mark.parametrize("broadcast, task", [(250_000, 0), (0, 0), (0, 250), (0, 250_000)])
def test_components(spark, broadcast, task, monkeypatch):
    monkeypatch.setattr(components, "BROADCAST_EDGES", broadcast)
    monkeypatch.setattr(components, "TASK_EDGES", task)
    monkeypatch.setattr(common, "ROWS_A_SALT", 20)
    rnd = random.Random(8)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [(900, i) for i in range(901, 960)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)


def test_least_labels():
    rng = np.random.default_rng(2)
    path = np.arange(5000)
    rng.shuffle(path)
    assert (components.least_labels(5000, path[:-1], path[1:]) == 0).all()
    star = np.arange(1, 5000)
    assert (components.least_labels(5000, star, np.full(4999, 4999)) == np.append(0, np.ones(4999))).all()
    assert components.least_labels(3, star[:0], star[:0]).tolist() == [0, 1, 2]


# --- decontamination ---


def find(items, text):
    """(item, start, end, equal) of the overlaps of one text (hashes of tokens) with items, through seeds; no Spark."""
    table = {}
    for i, x in enumerate(items):
        masks = decontaminate.masks_for(len(x))
        for m, h in zip(masks, decontaminate.masked(x, masks), strict=True):
            for at, seed in enumerate(h.tolist()):
                table.setdefault(seed, []).append((i, at))

    class Everything:
        passing = staticmethod(lambda h: np.arange(len(h)))

    masks = sorted({m for x in items for m in decontaminate.masks_for(len(x))})
    _, at, seed = decontaminate.window_hits(np.array([len(text)]), text, masks, Everything)
    found = {(i, p - q) for p, h in zip(at.tolist(), seed.tolist(), strict=True) for i, q in table.get(h, [])}
    return sorted((i, *seg) for i, d in found if (seg := decontaminate.verify(text, items[i], d)))


def brute_force(items, text):
    """Items that the rule finds on any diagonal, without seeds."""
    out = set()
    for i, x in enumerate(items):
        if len(x) < decontaminate.LEAST_ITEM:
            out |= {i} if len(x) and len(x) == len(text) and (x == text).all() else set()
            continue
        p, q = np.nonzero(text[:, None] == x[None, :])
        diagonals, n = np.unique(p - q, return_counts=True)
        least = decontaminate.least_length(len(x))
        for d in diagonals[n >= 0.8 * least].tolist():
            a, b = max(0, -d), min(len(x), len(text) - d)
            sums = np.concatenate([[0], np.cumsum(x[a:b] == text[a + d : b + d])]) * 5 - 4 * np.arange(b - a + 1)
            if b - a >= least and (sums[least:] >= np.minimum.accumulate(sums)[: len(sums) - least]).any():
                out.add(i)
    return out


def one(text):
    return decontaminate.tokens([text])[1]


def test_masks_miss_nothing():
    """Every way to place as many substitutions as the rule allows in 13 to 25 tokens leaves a window of a mask untouched."""
    assert decontaminate.MIN_TOKENS == 13 and decontaminate.MIN_AGREE == 0.8
    for n in range(13, 26):
        ways = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(n), n // 5)], np.int64)
        found = np.zeros(len(ways), bool)
        for m in decontaminate.MASKS:
            v = sum(1 << i for i, c in enumerate(m) if c == "1")
            for at in range(n - len(m) + 1):
                found |= ways & (v << at) == 0
        assert found.all(), n


def test_decontaminate_query(spark):
    """The registered query against brute force over all diagonals and segments, whole tables."""
    items = {r[0]: one(r[1] or "") for r in rows("benchmark")}
    texts = {r[0]: one(r[1] or "") for r in rows("documents")}
    names = list(items)
    got = {r.doc_id: (r.contaminated, set(r.item_ids)) for r in queries.op3_decontaminate(spark, FOLDER).collect()}
    right = {i: {names[j] for j in brute_force(list(items.values()), w)} for i, w in texts.items()}
    assert got == {i: (bool(x), x) for i, x in right.items()} and any(right.values())


def test_substituted_passages(spark):
    rnd = random.Random(2)
    item = [f"t{rnd.randrange(500)}" for _ in range(40)]
    docs, expect = [], {}
    for i in range(30):
        w = [f"d{rnd.randrange(500)}" for _ in range(200)]
        if i % 3 == 0:
            part = list(item)
            for j in range(3, 40, 9):  # every ninth token is another
                part[j] = "changed"
            w[50:50] = part
        elif i % 3 == 1:
            w[50:50] = item[:7]  # too short to count
        docs.append((i, " ".join(w).upper() + "!"))
        expect[i] = i % 3 == 0
    bench = spark.createDataFrame([(5, ", ".join(item)), (6, "three small words here now")], "item_id bigint, text string")
    got = decontaminate.judge(spark.createDataFrame(docs, "doc_id bigint, text string"), bench)
    assert {r.doc_id: r.contaminated for r in got.collect()} == expect
    for s in (r.spans[0] for r in got.filter("contaminated").collect()):
        assert s.item_id == 5 and (s.start, s.end, s.equal) == (50, 89, 35)  # the last token is another


def test_without_broadcasts(spark, monkeypatch):
    """Salted joins in place of broadcasts, a filter that lets most windows pass, small chunks: the result is the same."""
    docs, bench = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    key = lambda: sorted((r.doc_id, r.contaminated, tuple(r.item_ids), r.overlap_tokens) for r in decontaminate.judge(docs, bench).collect())
    whole = key()
    for name, value in (("FILTER_BITS", 8), ("LEAST_BITS", 8), ("BROADCAST_ROWS", 0), ("BROADCAST_BYTES", 0)):
        monkeypatch.setattr(decontaminate, name, value)
    monkeypatch.setattr(common, "ROWS_A_SALT", 50)
    assert key() == whole and any(x for _, x, *_ in whole)
    assert decontaminate.drop_contaminated(docs, bench).count() == sum(not x for _, x, *_ in whole)


def test_chunks(monkeypatch):
    """Chunks of tokens cut nothing, and windows do not reach into the next document."""
    flat = np.random.default_rng(2).integers(1, 40, 5000).astype(np.uint64)
    counts = np.array([0, 3, 13, 2000, 0, 1, 2900, 83, 0])
    assert counts.sum() == 5000

    class Some:
        passing = staticmethod(lambda h: np.flatnonzero(h % np.uint64(7) == 0))

    found = []
    for size in (1 << 16, 64):
        monkeypatch.setattr(decontaminate, "CHUNK", size)
        found.append(sorted(zip(*(x.tolist() for x in decontaminate.window_hits(counts, flat, list(decontaminate.MASKS), Some)), strict=True)))
    assert found[0] == found[1]
    shortest = min(map(len, decontaminate.MASKS))
    assert all(p + shortest <= counts[d] or counts[d] < decontaminate.LEAST_ITEM for d, p, _ in found[0]) and {d for d, *_ in found[0]} >= {1, 3, 5, 6}


def test_exact_windows():
    """Whatever shares thirteen tokens in a row with an item is found there, wherever in the item they are."""
    rnd = random.Random(9)
    item = one(" ".join(f"t{rnd.randrange(99)}" for _ in range(60)))
    for a in range(47):
        text = np.concatenate([one("x y z"), item[a : a + 14], one("p q r")])
        n = min(14, 60 - a)
        assert any(s <= 3 and e >= 3 + n for _, s, e, _ in find([item], text))


def test_random_substitutions():
    """Items of any length with random substitutions, against brute force over all segments."""
    rnd = np.random.default_rng(12)
    for k in range(400):
        n = int(rnd.integers(5, 60))
        item = rnd.integers(1, 2**60, n).astype(np.uint64)
        part = np.where(rnd.random(n) < (0.1, 0.15, 0.2, 0.25)[k % 4], np.uint64(7), item)
        a = int(rnd.integers(0, n // 2))
        text = np.concatenate([np.full(9, 3, np.uint64), part[a:], np.full(9, 4, np.uint64)])
        assert bool(find([item], text)) == bool(brute_force([item], text)), k


def test_any_segment_counts():
    """Verification against all segments by brute force, and a verbatim run followed by a stretch that agrees less."""
    rnd = np.random.default_rng(4)
    for k in range(600):
        n = int(rnd.integers(5, 70))
        equal = rnd.random(n) >= (0.15, 0.2, 0.25)[k % 3]
        least = int(rnd.integers(5, 14))
        sums = np.concatenate([[0], np.cumsum(equal)])
        right = {(a, b) for a in range(n) for b in range(a + least, n + 1) if 5 * (sums[b] - sums[a]) >= 4 * (b - a)}
        got = decontaminate.verified_segment(equal, least)
        assert (got is None) == (not right) and (got is None or (got[:2] in right and got[2] == sums[got[1]] - sums[got[0]]))
    item = [f"t{i}" for i in range(53)]
    changed = [13 + 10 * r + j for r in range(4) for j in (0, 3, 6)]
    text = ["changed" if i in changed else t for i, t in enumerate(item)]
    assert find([one(" ".join(item))], one(" ".join(text)))
    assert find([one(" ".join(item[:51]))], one(" ".join(t if i in (*range(13), *range(19, 32), *range(38, 51)) else "other" for i, t in enumerate(item[:51]))))


def test_short_items():
    """Items of 5 to 12 tokens with substitutions are found where brute force over all segments finds them."""
    rnd = np.random.default_rng(8)
    for n in range(5, 13):
        item, least = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(7919), decontaminate.least_length(n)
        for equal in [np.arange(n) != k for k in range(n)] + [rnd.random(n) >= 0.2 for _ in range(60)]:
            text = np.concatenate([np.full(9, 3, np.uint64), np.where(equal, item, np.uint64(5)), np.full(9, 3, np.uint64)])
            right = any(5 * equal[a:b].sum() >= 4 * (b - a) for a in range(n) for b in range(a + least, n + 1))
            assert bool(find([item], text)) == right, (n, equal)


# --- quality rules ---


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 100), (1, 500), (3, 1000), (40, 5000), (2, 100), (0, 1)]
    df = spark.createDataFrame(cases, "k bigint, n bigint")
    got = [r.p for r in df.select(quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p")).collect()]
    for (k, n), p in zip(cases, got, strict=True):
        assert p == pytest.approx(1.0 if k >= n * 0.01 else sum(comb(n, i) * 0.01**i * 0.99 ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_risk_is_controlled(spark):
    """Cutoffs that would reject 5 percent of good documents are not certified, those that reject none are."""
    good = [(i, "en", 8 if i % 20 == 0 else 0, False) for i in range(4000)] + [(10_000 + i, "de", 0, False) for i in range(4000)] + [(20_000 + i, "fr", 0, False) for i in range(50)]
    measured = spark.createDataFrame(good, "doc_id bigint, stratum string, severity int, base_failed boolean")
    labels = measured.select("doc_id", F.lit(1).alias("quality"))
    assert {r.stratum: r.least for r in quality_rules.calibrate(measured, labels).collect()} == {"en": 9, "de": 1, "fr": 9}


# --- mixing and sharding ---


def targets(sizes, weights=(5.0, 2.0, 1.0)):
    """Targets source by source, by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, opened, out = 1.5 * sum(sizes.values()), list(names), {}
    while opened:
        unit = left / sum(weight[s] for s in opened)
        over = [s for s in opened if weight[s] * unit > 2 * sizes[s]]
        out |= {s: 2.0 * sizes[s] for s in over} or {s: weight[s] * unit for s in opened}
        left -= sum(2 * sizes[s] for s in over)
        opened = [s for s in opened if s not in out]
    return out


def test_targets(spark):
    rnd = random.Random(5)
    for sizes in ({"b": 100, "a": 100, None: 100}, {"a": 0}, {"é": 5, "z": 7, "Z": 100_000, "": 3, None: 0}, {f"s{i}": rnd.randrange(10**rnd.randrange(1, 6)) for i in range(300)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(targets(sizes))
    assert mixing.targets(df.limit(0)).count() == 0
    assert targets({"b": 100, "a": 100, None: 100}) == {"a": 200.0, "b": pytest.approx(250 * 2 / 3), None: pytest.approx(250 / 3)}


def test_repeated_keys(spark, monkeypatch):
    """Most rows share id, source and size: blocks and numbering are split, totals stay near their targets."""
    for name, value in (("BLOCK", 50), ("LANDING", 30), ("ROWS_A_SALT", 40), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(mixing, name, value)
    data = [(None, "five words are in here", "s")] * 700 + [(7, "five words are in here", "t")] * 300 + [(i, "w " * (1 + i % 30), "st"[i % 2]) for i in range(100, 400)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(3)
    c = mixing.copies(df)
    for r in c.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 40
    m = mixing.mixed(df)
    want = {(r.doc_id, r.source): r.n for r in c.groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect()}
    assert {(r.doc_id, r.source): r.n for r in m.groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()} == {k: n for k, n in want.items() if n}


def test_flight_balances():
    rnd = np.random.default_rng(3)
    p, s = np.full(5000, 0.37), rnd.integers(1, 2000, 5000).astype(float)
    out = mixing.flight(p, s, np.random.default_rng(1))
    opened = (out > 1e-9) & (out < 1 - 1e-9)
    assert opened.sum() <= 2 and out.sum() == pytest.approx(p.sum()) and out @ s == pytest.approx(p @ s)
    landed = mixing.landing(p, s, np.random.default_rng(1))
    assert set(np.unique(landed)) <= {0.0, 1.0} and abs(landed @ s - p @ s) < 50
    chosen = np.mean([mixing.flight(np.full(30, 0.37), s[:30], np.random.default_rng(k)) for k in range(400)], axis=0)
    assert abs(chosen - 0.37).max() < 0.13  # inclusion probabilities are kept


def test_mixing_query(spark):
    docs = {r[0]: r for r in rows("documents")}
    got = queries.op7_mixing(spark, FOLDER).collect()
    sizes = collections.Counter()
    for i, t, _, src, _ in docs.values():
        sizes[src] += len(WORD.findall(t or ""))
    aims = targets(sizes)
    for r in got:
        assert r.size == len(WORD.findall(docs[r.doc_id][1] or "")) and r.source_size == sizes[docs[r.doc_id][3]] and r.target == pytest.approx(aims[docs[r.doc_id][3]])
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
    again = queries.op7_mixing(spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mixing_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 100)
    monkeypatch.setattr(mixing, "LANDING", 20)
    df = spark.createDataFrame([(i, "w " * (1 + i % 37), f"s{i % 2}") for i in range(3000)], "doc_id bigint, text string, source string")
    c = mixing.copies(df)
    for r in c.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 40


def test_differencing():
    rnd = np.random.default_rng(5)
    sizes = rnd.integers(1, 10_000, 3000)
    parts = np.zeros((3000, 40), np.int64)
    parts[:, 0] = sizes
    sums, labels = sharding.difference(parts)
    assert (np.bincount(labels[:, 0], weights=sizes, minlength=40) == sums).all() and sums.max() - sums.min() <= 20
    lucky = sharding.difference(np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]]))
    assert sorted(lucky[0].tolist()) == [14, 16]  # the textbook case


def test_sharding_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 300)
    monkeypatch.setattr(sharding, "BLOCK_ABOVE", 3)
    monkeypatch.setattr(sharding, "BUCKET", 50)
    df = spark.createDataFrame([(i, "x" * (i % 700) + str(i // 3)) for i in range(6000)], "doc_id bigint, text string")
    got = sharding.shard(df, keep=["doc_id", "text"]).collect()
    by, slots, where = collections.Counter(), collections.defaultdict(list), {}
    for r in got:
        by[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert where.setdefault(r.text, r.shard) == r.shard and r.text_crc32 == zlib.crc32(r.text.encode())
    assert len(by) == 40 and max(by.values()) - min(by.values()) < 200 and all(sorted(x) == list(range(len(x))) for x in slots.values())


# --- archives ---


def test_zip64_and_comments():
    records = [warc.record_bytes(f"urn:page:{i}", "http://a/", b"x" * i, "D" * 32, None) for i in range(20)]
    index, at = [], 0
    for r in records:
        index.append({"url": "u", "offset": at, "length": len(r), "filename": "data.warc.gz"})
        at += len(r)
    for zip64 in (False, True):
        data = warc.archive_bytes(records, index, zip64)
        out = io.BytesIO(data)
        with zipfile.ZipFile(out, "a") as z:
            z.comment = b"PK\x05\x06 not the end"
        data = out.getvalue()
        got = list(warc.record_ranges(lambda o, n, data=data: data[o : o + n], len(data)))
        assert [data[o : o + n] for o, n in got] == records
        assert warc.parse_record(data[got[7][0] : got[7][0] + got[7][1]])["payload"] == b"x" * 7
    # a directory that needs the ZIP64 end record and extra fields
    plain = warc.archive_bytes(records, index)
    end = plain.rindex(warc.END)
    entries, size, start = struct.unpack_from("<HII", plain, end + 10)
    d, wide = plain[start : start + size], b""
    while d:
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", d, 28)
        n = 46 + n_name + n_extra + n_comment
        stored, whole, local = *struct.unpack_from("<II", d, 20), struct.unpack_from("<I", d, 42)[0]
        head = d[:20] + b"\xff" * 8 + struct.pack("<HHH", n_name, 28, 0) + d[34:42] + b"\xff" * 4
        wide += head + d[46 : 46 + n_name] + struct.pack("<HHQQQ", 1, 24, whole, stored, local)
        d = d[n:]
    end64 = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, entries, entries, len(wide), start)
    locator = warc.LOCATOR64 + struct.pack("<IQI", 0, start + len(wide), 1)
    data = plain[:start] + wide + end64 + locator + warc.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert [data[o : o + n] for o, n in warc.record_ranges(lambda o, n: data[o : o + n], len(data))] == records
    with pytest.raises(ValueError):
        list(warc.record_ranges(lambda o, n: b"x" * n, 100))


def test_payloads_come_back(spark, tmp_path):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    twice = pages.unionByName(pages.withColumn("page_id", F.col("page_id") + 10_000))
    manifest = warc.write_archives(twice, f"{tmp_path}/w")
    got = warc.read_archives(manifest)
    first = {r.page_id: r.payload for r in got.filter("record_type = 'response'").collect()}
    assert {i: (h or "").encode() for i, _, h in rows("pages")} == {i: bytes(p) for i, p in first.items()}
    assert got.filter("record_type = 'revisit' and refers_to = page_id - 10000").count() == pages.count()
    assert warc.plan_records(twice, "page_id", "url", "html", 10**9).filter("refers_to is not null").count() == 0


# --- classifiers ---


def test_language_accuracy(spark):
    lang = {r[0]: r[2] for r in rows("documents")}
    held = [r for r in queries.op5_language_id(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    lang = {i: x for i, x in duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held if lang[r.doc_id]]) > 0.97


@pytest.mark.parametrize(("name", "label", "cut"), [("op6_toxicity", "toxic", 0.5), ("op8_quality_classifier", "quality", 0.3)])
def test_label_accuracy(spark, name, label, cut):
    y = {i: x for i, x in duckdb.sql(f"SELECT doc_id, {label} FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()}
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and all(r.predicted == (r.score >= cut) for r in got)
    assert np.mean([r.predicted == y[r.doc_id] for r in got if r.held_out and r.doc_id in y]) > 0.9


def brute_cosines(vectors, terms):
    dense = np.zeros((len(vectors), terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    return dense


@pytest.mark.parametrize(("dense", "block", "first"), [(0, 32, 4), (40, 32, 1), (40, 7, 2), (200, 32, 4)])
def test_block_max_search_is_exact(dense, block, first, monkeypatch):
    for name, value in (("DENSE", dense), ("BLOCK", block), ("FIRST", first)):
        monkeypatch.setattr(toxicity, name, value)
    rnd = np.random.default_rng(6)
    vectors = []
    for k in range(500):
        t = np.sort(rnd.choice(200, 12, replace=False, p=np.arange(200, 0, -1) / 20100))
        w = rnd.random(12) * (1 + t / 20)
        vectors.append((t, w / np.linalg.norm(w)) if k % 50 else vectors[-1] if vectors else (t, w / np.linalg.norm(w)))
    ids = rnd.permutation(10_000)[:500].tolist()
    index = toxicity.Index(ids, rnd.integers(0, 2, 500), vectors, 200)
    all_ = brute_cosines(vectors, 200)
    got = index.search(vectors, 16, list(range(500)))
    for q in range(500):
        exact = np.round(all_ @ all_[q], 12)
        exact[q] = -1
        order = np.lexsort((ids, -exact))[:16]
        at, cos = got[q]
        assert [index.ids[i] for i in at] == [ids[i] for i in order if exact[i] > 0] and np.allclose(cos, exact[order][exact[order] > 0])


def test_toxicity_query(spark):
    """score() against cosines, neighbours and votes by brute force over words of whole texts, weights taken from the model."""
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    everything = F.lit(True)
    m = toxicity.fit(docs, labels, everything, "toxic", "doc_id", "text")
    texts, label = {r[0]: r[1] or "" for r in rows("documents")}, {r[0]: r[2] for r in rows("labels")}
    forms = lambda t: collections.Counter(f for w in re.findall(r"[^\W\d_]+", t.lower()) for f in (w, *(w[:n] + "*" for n in (4, 5) if len(w) > n)))
    counts = {i: forms(t) for i, t in texts.items()}
    n = len(texts)
    toxic = [i for i in label if label[i] and i in texts]
    share = np.mean([label[i] for i in label])
    df, with_ = collections.Counter(), collections.Counter()
    for c in counts.values():
        df.update(c.keys())
    for i in toxic:
        with_.update(counts[i].keys())
    known = {t for i in label if i in counts for t in counts[i]}
    idf = lambda t: np.log((n * (1 - share) + 2) / (min(max(0, df[t] - n * share * with_[t] / len(toxic)), n * (1 - share)) + 1))
    vec = {}
    for i, c in counts.items():
        v = {t: (1 + np.log(k)) * idf(t) ** toxicity.POWER for t, k in c.items()}
        norm = np.sqrt(sum(x * x for x in v.values())) or 1
        vec[i] = {t: x / norm for t, x in v.items()}
    got = {r.doc_id: r for r in toxicity.score(docs, labels, everything).collect()}
    a, b = m["curve"]
    for i in texts:
        cos = {j: sum(x * vec[j][t] for t, x in vec[i].items() if t in vec[j]) for j in label if j in vec}
        best = sorted((j for j in cos if cos[j] > 1e-12), key=lambda j: (-round(cos[j], 9), j))[: toxicity.NEIGHBOURS]
        e = got[i].evidence
        # terms that no example has share the frequencies of buckets, which moves norms, and so all cosines of a text, a little
        ratio = [x.cosine / cos[j] for x, j in zip(e, best, strict=True)]
        assert np.allclose(ratio, ratio[:1] * len(best), rtol=1e-6) and (i in label or abs(ratio[0] - 1) < 0.05 if e else not best), (i, ratio, [x.doc_id for x in e], best)
        assert i not in label or np.allclose(ratio, 1)
        vote = sum(x.cosine * x.label for x in e) / (sum(x.cosine for x in e) + toxicity.DOUBT)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-(a * vote + b)))) and all(x.label == label[x.doc_id] for x in e)
        assert bool(e) == any(t in known and idf(t) > 0 for t in counts[i])


def test_toxicity_over_all_terms(spark):
    """A toxic example whose words few others have is the nearest of its copy, and every text that shares a word has evidence."""
    common = [(i, f"filler{i % 7} plain{i % 11} insultword badword" if i % 2 else f"filler{i % 7} plain{i % 11} fine{i % 5}", i % 2) for i in range(80)]
    rare = [(100, "zweifel quorvax mindelor", 1), (101, "gorbanik tellusor", 0)]
    train = spark.createDataFrame([(i, y) for i, _, y in common + rare], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(i, t) for i, t, _ in common + rare] + [(200, rare[0][1]), (201, "gorbanik elsewhere"), (202, "unseen")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, train, F.lit(True)).collect()}
    e = got[200].evidence
    assert [(x.doc_id, x.label) for x in e] == [(100, 1)] and e[0].cosine == pytest.approx(1)
    assert [x.doc_id for x in got[201].evidence] == [101] and got[202].evidence == [] and got[200].score > got[202].score


def test_run_hashes():
    """Runs as regular expressions find them, one hash for each word, prefixes only of longer words, any cut into slices."""
    rnd = random.Random(3)
    texts = [t for _, t, *_ in rows("documents")][:60] + [None, "", "   ", "a", "İstanbul STRASSE straße ½ x_y 12a", "ab" * 40_000, "".join(rnd.choice("aé1_ \n.") for _ in range(9000))]
    for kind, pattern in (("letters", None), ("letters and digits", r"[^\W_]+"), ("all but spaces", None)):
        cls = {"letters": str.isalpha, "letters and digits": str.isalnum, "all but spaces": lambda c: 0 if c.isspace() or c == "\0" else 1 if c.isalpha() else 2 if c.isdecimal() else 4 if c == "_" else 3}[kind]
        words = [["".join(g) for k, g in itertools.groupby((t or "").lower(), cls) if k] for t in texts]
        assert pattern is None or words == [re.findall(pattern, (t or "").lower()) for t in texts]
        for size in (runs.SLICE, 50):
            runs.SLICE, was = size, runs.SLICE
            counts, (h, four) = runs.run_hashes([t.encode() if t and len(t) % 2 else t for t in texts], kind, (4,))
            runs.SLICE = was
            flat = [w for ws in words for w in ws]
            assert counts.tolist() == [len(ws) for ws in words]
            assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))
            assert all((x > 0) == (len(w) > 4) for w, x in zip(flat, four.tolist(), strict=True)) and len({(w[:4], x) for w, x in zip(flat, four.tolist(), strict=True) if x}) == len({w[:4] for w in flat if len(w) > 4})
    known = np.unique(np.random.default_rng(1).integers(1, 2**63, 5000).astype(np.uint64))
    look = runs.Lookup(known)
    assert (look.places(known) == np.arange(len(known))).all() and (look.places(np.array([1, 2, 3], np.uint64)) == -1).all() and len(runs.Lookup(known[:0]).places(known)) == len(known)


def test_temperature():
    rnd = np.random.default_rng(2)
    z = rnd.normal(size=(4000, 3)) * 2
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([rnd.choice(3, p=x) for x in p])
    assert language.fit_temperature(z * 5, y) == pytest.approx(5, rel=0.15)


# --- pipeline ---


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    texts = {r[0]: r[1] or "" for r in rows("documents")}
    assert ids <= set(texts) and len(ids) > 0.4 * len(texts)
    c = expected_components({i: texts[i] for i in ids})
    assert all(c[i] == i for i in ids)
    assert not set(r.doc_id for r in decontaminate.judge(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/benchmark.parquet")).filter("contaminated").collect()) & ids
