"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Tokens are lower-cased runs of letters, of digits, of underscores or of other signs, hashed into ROWS rows (so rare
words share a row). Every row has a fixed sparse random index vector (NONZERO entries of +1 or -1 among DIM); a row's word vector is the sum of the index vectors of its
neighbours, up to WINDOW places away, over all documents of the corpus, then weighted down by frequency and
normalised. A document is pooled into the mean, the spread and the extremes of its tokens' vectors, with the
length of the mean and the logarithms of its counts. The network (one hidden layer, logistic output) is trained with Adam on a bounded,
balanced sample of labelled documents (SAMPLE), all of whose text is used; a part held back stops training early and
fits the temperature, and the odds are set back from the sample's to the labels' true class sizes.

Nulls and odd inputs: a null, empty or token-free text has zero features and gets the score of such. Without labels of
both classes every score is the share of good labels (0 without any). Repeated documents get a row each; empty tables
give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import array_sum, ddl, texts
from .labelled import sample_labels, sampled
from .runs import run_hashes

ROWS, DIM, NONZERO, WINDOW = 1 << 15, 48, 4, 2
SAMPLE, HIDDEN, EPOCHS, BATCH, RATE, DECAY = 4000, 32, 60, 64, 3e-3, 1e-4
#: Tokens that are counted at once.
CHUNK = 1 << 19
FEATURES = 4 * DIM + 4

_rand = np.random.default_rng(20240607)
_AT = np.argsort(_rand.random((ROWS, DIM)), axis=1)[:, :NONZERO]
_SIGN = _rand.integers(0, 2, (ROWS, NONZERO)) * 2 - 1


def token_rows(batch: list[bytes | str | None]) -> list[np.ndarray]:
    """Rows of the tokens of each text."""
    counts, hashes = run_hashes(batch, "all but spaces")
    flat = (hashes[0] >> np.uint64(64 - ROWS.bit_length() + 1)).astype(np.int64)
    return np.split(flat, np.cumsum(counts)[:-1]) if len(counts) else []


def context_sums(rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """(ROWS, DIM) sums of the index vectors of neighbours; ``doc`` keeps neighbours inside a document."""
    out = np.zeros(ROWS * DIM)
    for gap in range(1, WINDOW + 1):
        same = doc[gap:] == doc[:-gap]
        left, right = rows[:-gap][same], rows[gap:][same]
        for mid, near in ((left, right), (right, left)):
            for j in range(NONZERO):
                out += np.bincount(mid * DIM + _AT[near, j], weights=_SIGN[near, j], minlength=ROWS * DIM)
    return out


def corpus_sums(docs: DataFrame, text_col: str) -> np.ndarray | None:
    """Context sums and, after them, token counts of all rows over the whole corpus."""

    def run(batches):
        total = np.zeros(ROWS * DIM + ROWS, np.int64)
        rows: list[np.ndarray] = []
        n = 0

        def add():
            nonlocal rows, n
            if rows:
                flat = np.concatenate(rows)
                doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
                total[: ROWS * DIM] += np.rint(context_sums(flat, doc)).astype(np.int64)
                total[ROWS * DIM :] += np.bincount(flat, minlength=ROWS)
            rows, n = [], 0

        for batch in batches:
            for r in token_rows(texts(batch, text_col)):
                rows.append(r)
                n += len(r)
                if n >= CHUNK:
                    add()
        add()
        return total

    return array_sum(docs.select(text_col), run, np.int64, fan_in=8)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    v = sums[: ROWS * DIM].reshape(ROWS, DIM).astype(np.float64)
    count = sums[ROWS * DIM :].astype(np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return (v * (1e-3 / (1e-3 + count / max(1.0, count.sum())))[:, None]).astype(np.float32)


def pooled(rows: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    out = np.zeros(FEATURES, np.float32)
    if not len(rows):
        return out
    at, n = np.unique(rows, return_counts=True)
    v = vectors[at]
    share = (n / n.sum()).astype(np.float32)
    mean = share @ v
    out[:DIM], out[DIM : 2 * DIM] = mean, np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
    out[2 * DIM : 3 * DIM], out[3 * DIM : 4 * DIM] = v.max(axis=0), v.min(axis=0)
    out[4 * DIM :] = np.linalg.norm(mean), np.log1p(len(rows)), np.log1p(len(at)), -float((share * np.log(share)).sum())
    return out


def forward(x: np.ndarray, net: dict) -> np.ndarray:
    """Logits."""
    h = np.maximum((x - net["mean"]) / net["scale"] @ net["w1"] + net["b1"], 0)
    return h @ net["w2"] + net["b2"]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, z) - y * z).mean())


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> dict:
    """The network with the least loss on the fifth that is held back; its temperature is fitted there too."""
    rand = np.random.default_rng(seed)
    order = rand.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    scale = x[used].std(axis=0)
    net = {"mean": x[used].mean(axis=0), "scale": np.where(scale > 1e-6, scale, 1.0)}
    net |= {"w1": rand.normal(0, (2 / x.shape[1]) ** 0.5, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rand.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN), "b2": np.zeros(())}
    names = ("w1", "b1", "w2", "b2")
    m, v, step = {k: np.zeros_like(net[k]) for k in names}, {k: np.zeros_like(net[k]) for k in names}, 0
    best, least = {k: net[k].copy() for k in names}, np.inf
    xs = (x - net["mean"]) / net["scale"]
    for _ in range(EPOCHS):
        p = rand.permutation(used)
        for i in range(0, len(p), BATCH):
            b = p[i : i + BATCH]
            a = xs[b] @ net["w1"] + net["b1"]
            h = np.maximum(a, 0)
            d = (_sigmoid(h @ net["w2"] + net["b2"]) - y[b]) / len(b)
            back = np.outer(d, net["w2"]) * (a > 0)
            grad = {"w1": xs[b].T @ back + DECAY * net["w1"], "b1": back.sum(axis=0), "w2": h.T @ d + DECAY * net["w2"], "b2": d.sum()}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                net[k] = net[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        check = held if len(held) else used
        if (now := _loss(forward(x[check], net), y[check])) < least:
            best, least = {k: net[k].copy() for k in names}, now
    net |= best
    check = held if len(held) else used
    z = forward(x[check], net)
    net["t"] = min((1.05 ** np.arange(-60, 61)).tolist(), key=lambda t: _loss(z / t, y[check]))
    return net


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str, id_col: str, text_col: str) -> dict:
    sample, sizes = sample_labels(labels, label_col, learn, SAMPLE, id_col)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    sums = corpus_sums(docs, text_col)
    if sums is None or not sizes.get(0) or not sizes.get(1):
        return {"share": share, "net": None}
    vectors = word_vectors(sums)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches):
        for batch in batches:
            x = [pooled(r, shared.value).tobytes() for r in token_rows(texts(batch, "text"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.binary())], ["i", "y", "x"])

    rows = sampled(docs, sample, id_col, text_col).select(F.col("__sw_id").alias("i"), F.col("label").cast("int").alias("y"), "text")
    got = sorted((r.i, r.y, bytes(r.x)) for r in rows.mapInArrow(features, f"{ddl(rows, 'i')}, y int, x binary").collect())
    shared.destroy()
    y = np.array([r[1] for r in got], float)
    if not len(y) or y.min() == y.max():
        return {"share": share, "net": None}
    net = train(np.array([np.frombuffer(r[2], np.float32) for r in got], float), y)
    # from the sample's odds to the labels'
    net["shift"] = float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return {"share": share, "net": net, "vectors": vectors}


def score(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep`` (the id, by default) and score for every row of docs. ``learn`` is a condition on labels."""
    keep = keep if keep is not None else {id_col: F.col(id_col)}
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, learn, label_col, id_col, text_col))
    src = docs.select(F.col(text_col).alias("__sw_text"), *[c.alias(n) for n, c in keep.items()])
    names = list(keep)

    def run(batches):
        m = shared.value
        for batch in batches:
            if m["net"] is None:
                out = np.full(batch.num_rows, m["share"])
            else:
                x = np.array([pooled(r, m["vectors"]) for r in token_rows(texts(batch, "__sw_text"))], float).reshape(-1, FEATURES)
                out = _sigmoid(forward(x, m["net"]) / m["net"]["t"] + m["net"]["shift"])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.float64())], [*names, "score"])

    return src.mapInArrow(run, f"{ddl(src, *names)}, score double")
