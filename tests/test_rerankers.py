import json
import os
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark import cloudpickle

from sievewell.config import Settings
from sievewell.plans import clients, engine, rerankers
from sievewell.sources import store

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def make(route):
    return clients.Scripted(lambda last: "3, 1" if "Passages:" in last else "By the source [1]" if "[1] (source:" in last else "")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    c = store.Corpus(spark, str(tmp_path_factory.mktemp("rerank") / "chunks"))
    engine.Engine(spark, Settings(), make, c).ingest(spark.createDataFrame([(f"d{i}", f"d{i}", "apple pear " + "plum " * i) for i in range(6)], "path string, source string, text string"))
    return c


def questions(spark, n=1):
    return spark.createDataFrame([(i, "apple pear") for i in range(n)], "qid int, query string")


class Counted:
    """A cross-encoder that notes each construction in a file."""

    def __init__(self, key):
        with open(key.model, "a") as f:
            f.write(f"{os.getpid()}\n")

    def scores(self, queries, texts):
        return [float(len(t)) for t in texts]


def test_local_is_made_once_a_worker(spark, corpus, tmp_path):
    s = Settings(reranker="local", reranker_model=str(tmp_path / "made"), top_k_final=2)
    e = engine.Engine(spark, s, make, corpus, reranker_builder=Counted)
    for _ in range(3):
        assert {r.source for r in e.retrieve(questions(spark, 40)).collect()} == {"d5", "d4"}
    made = (tmp_path / "made").read_text().split()
    assert made and len(made) == len(set(made))


class Service(BaseHTTPRequestHandler):
    seen: list = []
    fail = 2

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Service.seen.append((body, self.headers.get("Authorization")))
        if len(Service.seen) <= Service.fail:
            self.send_error(503)
            return
        out = json.dumps({"results": [{"index": i, "relevance_score": len(t) / 1000} for i, t in enumerate(body["documents"]) if "plum plum" in t]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *a):
        pass


@pytest.fixture()
def service():
    Service.seen = []
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/rerank"
    server.shutdown()


def test_hosted(spark, corpus, service):
    """Failures that may pass are tried again; texts without a score drop out; the floor counts."""
    s = Settings(reranker="hosted", reranker_model="m", reranker_url=service, top_k_final=3, relevance_floor=0.03)
    got = engine.Engine(spark, s, make, corpus).retrieve(questions(spark)).orderBy("rank").collect()
    assert [r.source for r in got] == ["d5", "d4"] and Service.seen[-1][0]["model"] == "m" and len(Service.seen) >= 3


def test_hosted_refuses(service, monkeypatch):
    with pytest.raises(ValueError, match="reranker_url"):
        rerankers.Hosted(rerankers.Key("hosted", "m", "", ""))
    with pytest.raises(ValueError, match="SOME_KEY"):
        rerankers.Hosted(rerankers.Key("hosted", "m", service, "SOME_KEY"))
    monkeypatch.setenv("SOME_KEY", "k")
    with pytest.raises(rerankers.urllib.error.HTTPError):
        rerankers.Hosted(rerankers.Key("hosted", "m", service, "SOME_KEY"), attempts=2, wait=0.01).of_one("q", ["t"])
    assert len(Service.seen) == 2 and Service.seen[0][1] == "Bearer k"
    assert rerankers.Hosted(rerankers.Key("hosted", "m", service, "")).of_one("q", ["a", "plum plum"]) == [None, 0.009]


def test_listwise_through_the_engine(spark, corpus):
    """Named passages first, then the others in their order, with the scores of the fusion; a batch may ask for it."""
    plain = engine.Engine(spark, Settings(top_k_final=6), make, corpus)
    before = [r.source for r in plain.retrieve(questions(spark)).orderBy("rank").collect()]
    llm = engine.Engine(spark, Settings(top_k_final=6, reranker="llm"), make, corpus)
    after = [r.source for r in llm.retrieve(questions(spark)).orderBy("rank").collect()]
    assert after == [before[2], before[0], before[1], *before[3:]]
    asked = plain.ask(questions(spark), reranked=True).first()
    assert [c.source for c in asked.citations] == after and asked.answered


def test_local_without_a_model(spark, corpus):
    try:
        import sentence_transformers  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="sentence-transformers"):
            rerankers.CrossEncoder(rerankers.Key("local", "m", "", ""))
