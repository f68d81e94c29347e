"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievewell.llm import decontaminate, language, minhash, mixing, quality_classifier, quality_rules, sharding, toxicity, url_filter, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, node int, size string, label string, shard int, stratum string, a int, rank int"
LABELS = "doc_id bigint, quality int, toxic int"
GOOD = " ".join(f"word{i} and other{i} things" for i in range(40))
LONG = " ".join(f"w{i % 9973}x{i}" for i in range(150_000))
BIG = 2**60 + 1


def rows():
    x = (1, "clash", "clash", 7, "clash", 1, 1)
    return [
        (1, GOOD, "en", "s", 5, *x), (2, GOOD, "en", "s", 5, *x), (2, GOOD, "en", "s", 5, *x), (3, None, None, None, None, *x), (4, "", "en", "s", 0, *x), (5, " \n\t ", None, "s", 1, *x),
        (6, LONG, "en", "t", 9, *x), (None, "a text without an id, which is a little longer than ten words are", "de", None, 1, *x), (None, GOOD + " end", "de", "t", 1, *x), (BIG, "12345 67890", "fr", "t", 1, *x), (8, "one two three", "fr", "u", 1, *x), (8, "one two three", "fr", "u", 1, *x),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (6, None, None), (None, 1, 1), (8, 0, 1), (99, 1, 0)], LABELS)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


PAGES = "page_id bigint, url string, html string, host string, rule string, prefix string, digest string, n int, k int"


def test_url_filter(spark):
    pages = [
        (1, None, None), (2, "no scheme", ""), (3, "http://A.Example.COM/en/7x?q#f", "x"), (4, "http://com/en/", "x"), (5, "x://", "x"), (6, "http://q.com?/en/", "x"), (7, "http://notexample.net/de/8", "x"), (7, "http://notexample.net/de/8", "x"),
        (None, "http://b.org/es/" + "p" * 100_000, "x"), (9, "http://example.net/de/88", "x"), (10, "http://a..com/en/z", "y"),
    ]
    df = spark.createDataFrame([(*p, "h", "r", "p", "d", 1, 1) for p in pages], PAGES)
    rules = url_filter.rule_table(spark, [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("allow", "example.net/de/8"), ("block", "org/es/"), ("block", "org/es/")])
    got = sorted((r.page_id or 0, r.host, r.path[:8], r.rule, r.verdict) for r in url_filter.filter_urls(df, rules).collect())
    assert got == [
        (0, "b.org", "/es/pppp", "org/es/", "block"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (4, "com", "/en/", "com/en/", "block"),
        (5, "", "", None, "allow"), (6, "q.com", "", None, "allow"), (7, "notexample.net", "/de/8", "net/de/", "block"), (7, "notexample.net", "/de/8", "net/de/", "block"), (9, "example.net", "/de/88", "example.net/de/8", "allow"), (10, "a..com", "/en/z", "com/en/", "block"),
    ]
    assert url_filter.filter_urls(df, rules.limit(0)).filter("verdict <> 'allow' or rule is not null").count() == 0
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0


def test_near_duplicates(docs, none):
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=str)
    n = len({tuple(GOOD.split()[i : i + 5]) for i in range(len(GOOD.split()) - 4)})
    by = {}
    for i, *x in got:
        by.setdefault(i, []).append(tuple(x))
    assert by[1] == [(n, 1, True)] and by[2] == [(n, 1, False)] * 2 and by[3] == [(0, 3, True)] and by[4] == [(0, 4, True)] and by[5] == [(0, 5, True)]
    assert by[6] == [(149_996, 6, True)] and by[8] == [(1, 8, True)] * 2 and by[BIG] == [(1, BIG, True)]
    assert sorted(by[0], key=str) == sorted([(n + 1, 1, False), (10, None, True)], key=str)
    assert minhash.near_duplicates(none).count() == 0


def test_drop_near_duplicates(docs, none):
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 3, 4, 5, 6, 8, BIG, None]))
    assert minhash.drop_near_duplicates(none).count() == 0


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, GOOD[40:300]), (1, GOOD[40:300]), (2, None), (3, ""), (4, "one two"), (5, "Ten, WORDS"), (6, "12345 67890"), (None, GOOD[300:500])], "item_id bigint, text string")
    got = {}
    for r in decontaminate.judge(docs, items).collect():
        got.setdefault(r.doc_id, []).append((r.contaminated, r.item_ids))
    assert got[1] == [(True, [1, None])] and got[2] == [(True, [1, None])] * 2 and (True, [1, None]) in got[None] and (False, []) in got[None]
    assert got[BIG] == [(True, [6])]  # an item of two tokens, and nothing else
    assert all(got[i] == [(False, [])] * len(got[i]) for i in (3, 4, 5, 6, 8))
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == 7
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.judge(none, items).count() == 0


def test_text_ids(spark, docs, labels):
    """Ids need not be numbers."""
    named, marked = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(named).filter("n_shingles > 100").collect()} >= {("d1", "d1"), ("d2", "d1"), ("d6", "d6"), (None, "d1")}
    assert minhash.drop_near_duplicates(named).count() == minhash.drop_near_duplicates(docs).count()
    items = spark.createDataFrame([("i", GOOD[40:300])], "item_id string, text string")
    assert {(r.doc_id, *r.item_ids) for r in decontaminate.judge(named, items).filter("contaminated").collect()} == {("d1", "i"), ("d2", "i"), (None, "i")}
    for module in (toxicity, quality_classifier):
        assert module.score(named, marked, F.lit(True)).filter("score >= 0").count() == docs.count()
    assert mixing.copies(named).count() == sharding.shard(named).count() == docs.count()


def test_quality_rules(docs, none, labels, no_labels):
    for lab in (labels, no_labels):
        got = quality_rules.judge(docs, lab)
        assert got.count() == docs.count()
        x = {r.doc_id: r for r in got.collect()}
        assert x[1].kept and not x[3].kept and x[3].n_words == 0 and x[3].base_failed and x[6].n_words == 150_000 and x[6].kept
    kept = quality_rules.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(map(str, [1, 2, 2, 6, None, None]))
    assert quality_rules.judge(none, labels).count() == 0 and quality_rules.drop_rejected(none, labels).count() == 0


def test_language(docs, none):
    everything = F.lit(True)
    got = {r.doc_id: r for r in language.identify(docs, everything).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == got[BIG].lang_pred == "und" and got[6].lang_pred in ("en", "de", "fr")
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in language.identify(docs, F.lit(False)).collect()} == {"und"}
    assert {r.lang_pred for r in language.identify(docs, F.col("lang") == "en").collect()} == {"und", "en"}
    assert language.identify(none, everything).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_scores(module, docs, none, labels, no_labels):
    got = module.score(docs, labels, F.lit(True))
    assert got.count() == docs.count() and got.filter("score is null or score < 0 or score > 1 or isnan(score)").count() == 0
    assert module.score(docs, no_labels, F.lit(True)).filter("score <> 0").count() == 0
    assert module.score(none, labels, F.lit(True)).count() == 0


def test_mixing(docs, none):
    c = mixing.copies(docs)
    assert c.count() == docs.count() and c.filter("copies < 0 or copies > 2").count() == 0
    assert c.filter("source is null").count() == 2
    again = mixing.copies(docs.repartition(3))
    key = lambda df: sorted((str(r.doc_id), r.size, r.copies) for r in df.collect())
    assert key(c) == key(again)
    m = mixing.mixed(docs)
    assert m.columns == docs.columns and m.count() == c.agg(F.sum("copies")).first()[0]
    assert mixing.copies(none).count() == 0 and mixing.mixed(none).count() == 0


def test_sharding(docs, none):
    got = sharding.shard(docs, keep=docs.columns[:4]).collect()
    assert len(got) == docs.count() and {r.law for r in got} == {"bytes"}
    assert len({r.shard for r in got if r.text == GOOD}) == 1
    assert {r.size for r in got if r.text is None} == {16} and {r.text_crc32 for r in got if r.text is None} == {0}
    for s in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(none).count() == 0


def test_warc(spark):
    data = [(1, "http://a/ b\r\nX: y", "same"), (2, None, "same"), (2, "u", "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (None, "u", "only nulls"), (5, "u", "é" * 2_000_000), (BIG, "u", "\r\n\r\n")]
    df = spark.createDataFrame([(*p, "h", "r", "p", "d", 1, 1) for p in data], PAGES)
    got = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    assert got == sorted([
        ("1", 4, "response", None), ("2", 4, "revisit", 1), ("2", 4, "revisit", 1), ("3", 0, "response", None), ("4", 0, "revisit", 3), ("None", 4, "revisit", 1), ("None", 10, "response", None), ("5", 4_000_000, "response", None), (str(BIG), 4, "response", None),
    ], key=lambda x: (x[0], x[1], x[2]))
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("i", range(len(corpus_pipeline.STAGES)))
def test_stages(i, spark, docs, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "something else entirely that is long enough for a mask of the seeds")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[i]
    for d in (docs, none):
        out = stage(spark, d, str(tmp_path))
        assert out.count() <= 2 * d.count()
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == d.columns
