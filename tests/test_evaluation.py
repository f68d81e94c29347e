import json
import sys

import pytest
from pyspark import cloudpickle

from sievewell.config import Settings
from sievewell.plans import clients, engine, evaluation, sql_gate
from sievewell.sources import catalog, documents, store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def make(route):
    def reply(last):
        if last.startswith("Schema:"):
            return "SELECT region, count(*) AS n FROM sales GROUP BY region" if "by region" in last else "DROP TABLE sales" if "Remove" in last else "SELECT count(*) FROM sales"
        if "Passages:" in last:
            return "2, 1"
        if "Summary:" in last:
            return "SCORE: 80\nPOINTS: something"
        if "Points:" in last:
            return "all in all"
        if last.startswith("Summarise:"):
            return last[11:]
        if "[1] (source:" in last:
            return "By the source [1]"
        words = last.split()
        return "\n".join([*(f"ENTITY|{w}|word|the word {w}" for w in words[:4]), f"RELATIONSHIP|{words[0]}|{words[1]}|next to" if len(words) > 1 else ""])

    return clients.Scripted(reply)


def judges(route):
    """Faithful if the sources hold Lisbon; relevancy without a number."""
    return clients.Scripted(lambda last: ("0.8 of 1" if "Lisbon" in last else "0.25") if last.startswith("Sources:") else "no number")


@pytest.fixture(scope="module")
def ready(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("evaluation")
    catalog.demo_sales(spark)
    corpus, graphs = store.Corpus(spark, f"{d}/chunks"), store.GraphStore(spark, f"{d}/graph")
    e = engine.Engine(spark, Settings(), make, corpus, None, graphs, ["sales"])
    e.ingest(spark.createDataFrame([("a.md", "Lisbon Oslo Rome offices"), ("b.md", "Lisbon Oslo Bern Tuesday")], "source string, text string"))
    engine.build_graph(corpus.chunks(), make, graphs)
    return e


def test_judge(spark):
    rows = spark.createDataFrame([(1, "q", "a", "Lisbon"), (2, "q", None, None)], "qid int, query string, answer string, context string")
    got = {r.qid: (r.faithfulness, r.relevancy) for r in evaluation.judge(rows, judges).collect()}
    assert got == {1: (0.8, 0.0), 2: (0.25, 0.0)}
    assert evaluation.judged_means(evaluation.judge(rows.limit(0), judges)) == {"faithfulness": None, "relevancy": None}


def test_run_eval(spark, ready, tmp_path):
    items = spark.createDataFrame([("Where are the offices?", ["a.md"]), ("What is there on Tuesday?", ["b.md"]), ("unlabelled Lisbon", [])], "question string, relevant_doc_ids array<string>")
    rows = evaluation.run_eval(ready, items, 2, judges)
    assert [r["config"] for r in rows] == ["vector-only", "hybrid", "hybrid+rerank"] and all(r["n"] == 2 and r["recall"] == 1.0 and r["hit"] == 1.0 for r in rows)
    assert all(r["faithfulness"] == 0.8 and r["relevancy"] == 0.0 and r["latency_ms"] > 0 for r in rows)
    assert "faithfulness" not in evaluation.run_eval(ready, items, 2, configs={"one": Settings(mode="vector")})[0]
    md, js = evaluation.save(str(tmp_path), "eval", rows, {"judge": "scripted"})
    assert "hybrid+rerank" in open(md).read() and json.load(open(js))[0]["judge"] == "scripted"


def test_sql_eval(spark, ready):
    items = [("How many sales?", "SELECT 10"), ("Sales by region", "SELECT 5 - 1, region FROM sales WHERE region = 'x'"), ("Sales by region", "SELECT region, count(*) FROM sales GROUP BY region ORDER BY 2"), ("Remove them", "SELECT 1")]
    runs = {(r.question, i): r for i, r in enumerate(evaluation.sql_runs(ready, items).collect())}
    assert [r.ok for r in runs.values()] == [True, False, True, False] and "unsafe" in runs[("Remove them", 3)].error
    s = evaluation.sql_eval(ready, items)
    assert (s["n"], s["accuracy"], s["tables"], s["trips"]) == (4, 0.5, 1.0, 0) and s["p95"] >= s["med"] > 0
    assert evaluation.sql_eval(ready, [])["accuracy"] == 0.0
    with pytest.raises(sql_gate.UnsafeSQL):
        evaluation.sql_eval(ready, [("x", "DELETE FROM sales")])


def test_overview_eval(spark, ready):
    items = spark.createDataFrame([("What is it all about?",), ("And Lisbon?",)], "question string")
    rows = {r["approach"]: r for r in evaluation.overview_eval(ready, items, judges)}
    assert set(rows) == {"hybrid", "graph"} and all(r["n"] == 2 and r["tokens"] > 0 and r["cost_usd"] == 0 for r in rows.values()) and rows["hybrid"]["faithfulness"] == 0.8 and rows["graph"]["faithfulness"] == 0.25
    assert all(r["faithfulness"] is None for r in evaluation.overview_eval(ready, items))


def test_summaries_hold_internal_edges(spark, ready):
    summaries = "\n".join(r.summary for r in ready.graphs.load()["communities"].collect())
    assert "Relationships:\n- Lisbon → Oslo: next to" in summaries


def test_ingest_sql_and_directory(spark, tmp_path):
    e = engine.Engine(spark, Settings(), make, store.Corpus(spark, f"{tmp_path}/chunks"))
    spark.createDataFrame([(2, "b", None), (1, "a", "x"), (None, "c", "y")], "id int, name string, note string").createOrReplaceTempView("notes")
    assert e.ingest_sql("SELECT * FROM notes", "id", "kb") == {"documents": 3, "chunks": 3}
    text = {r.source: r.content for r in e.corpus.chunks().collect()}
    assert text == {"kb:1": "id: 1 name: a note: x", "kb:2": "id: 2 name: b", "kb:null": "name: c note: y"}
    assert {r.source for r in documents.sql_documents(spark, "SELECT name FROM notes", "id", "kb").collect()} == {"kb:row-1", "kb:row-2", "kb:row-3"}
    assert documents.sql_documents(spark, "SELECT name FROM notes", None, "kb", ["name"], 1).collect()[0].text == "name: a"
    with pytest.raises(sql_gate.UnsafeSQL):
        e.ingest_sql("DROP VIEW notes")
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.md").write_text("one")
    (tmp_path / "docs" / "sub" / "a.md").write_text("two")
    assert e.ingest_directory(str(tmp_path / "docs"), (".md",)) == {"documents": 2, "chunks": 2}
    assert {"a.md", "sub/a.md"} <= {r.source for r in e.sources().collect()}
