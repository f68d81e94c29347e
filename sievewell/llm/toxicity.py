"""Toxicity by nearest labelled examples: exact TF-IDF cosine over all terms, by a block-max inverted index.

Terms are lower-cased words and, for longer words, their first four and five letters; they are told apart by 64-bit
hashes. A term's weight in a text is (1 + log count) x idf ** POWER. Document frequencies are counted over the whole corpus;
as the examples' labels tell what share of the toxic documents have a term, the frequency that these account for is
taken off, so that idf = log((clean documents + 2) / (clean documents with the term + 1)), as estimated, and words that only
toxic documents have count as the rare words that they are elsewhere. Every term of a text and of an example counts, and
vectors are normalised over all terms. (Terms that no example has only enter norms; their frequencies are those of DIM buckets.)

Examples are a bounded sample of labelled documents (EXAMPLES, half of each class where possible), similar ones side
by side in blocks of BLOCK. The search is Block-Max MaxScore: the inverted lists of all but the DENSE commonest terms are
traversed; for the commonest terms, whose lists are long and weights small, the index has the maximum for each block. A
block's examples are scored completely only if the best of its partial scores and these maxima can reach the K-th best
score known. So the K nearest are exact. Votes are weighted by cosine against a fixed weight of doubt; the vote is
calibrated by a logistic curve fitted on the examples, each scored without itself, weighted to the classes' true
sizes. Evidence is the ids of the nearest examples with their cosines and labels.

Nulls and odd inputs: a null, empty or term-free text, or one that shares no term with an example, has no neighbours
and gets the calibrated score of no evidence.
Without labels of both classes every score is the share of toxic labels (0 without any). Repeated documents get a row
each; of rows that share an example's id one serves as the example. Ids may be of any type that has an order. Empty
tables give empty results. Ties between examples (cosines equal to 12 digits) go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import array_sum, arrow_type, ddl, texts
from .labelled import sample_labels, sampled
from .runs import Lookup, run_hashes

#: Buckets of the document frequencies of terms that no example has.
DIM = 1 << 18
EXAMPLES = 4000
NEIGHBOURS, DOUBT = 16, 0.5
#: Exponent of idf; of 1, 1.5, 2, 2.5 and 3 the one with the least log loss on examples scored without themselves.
POWER = 2.0
#: Commonest terms, whose lists have block maxima; examples in a block; blocks scored first; texts searched at once. None changes a result.
DENSE, BLOCK, FIRST, QUERIES = 512, 32, 4, 128
PREFIXES = (4, 5)
#: A term's code in a text: its place among the examples' terms, or, if it is not among them, UNKNOWN and low bits of its hash.
CODE_BITS = 44
UNKNOWN = np.uint64(1 << CODE_BITS - 1)


def term_hashes(batch: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text's place in the batch, hash) of every word and prefix of every text."""
    counts, forms = run_hashes(batch, "letters", PREFIXES)
    doc = np.repeat(np.arange(len(batch)), counts)
    h = np.concatenate(forms)
    return np.tile(doc, len(forms))[h > 0], h[h > 0]


def term_counts(batch: list[bytes | None], lookup: Lookup) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, counts) of the distinct terms of each text, codes rising, so known terms come first."""
    doc, h = term_hashes(batch)
    at = lookup.places(h)
    code = np.where(at >= 0, at.astype(np.uint64), UNKNOWN | (h & (UNKNOWN - np.uint64(1))))
    key = np.sort((doc.astype(np.uint64) << np.uint64(CODE_BITS)) | code)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    n, key = np.diff(np.append(first, len(key))), key[first]
    code = (key & np.uint64((1 << CODE_BITS) - 1)).astype(np.int64)
    cut = np.searchsorted(key >> np.uint64(CODE_BITS), np.arange(len(batch) + 1, dtype=np.uint64))
    return [(code[a:b], n[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def arrange(x: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows of x in which similar ones are near: halved, by the direction of the largest spread, down to ``size``."""
    parts, done = [np.arange(len(x))], []
    while parts:
        p = parts.pop()
        if len(p) <= size:
            done.append(p)
            continue
        y = x[p] - x[p].mean(axis=0)
        v = np.ones(x.shape[1]) / max(1, x.shape[1]) ** 0.5 + np.linspace(0, 1e-3, x.shape[1])
        for _ in range(8):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) or 1
        p = p[np.argsort(y @ v, kind="stable")]
        half = -(-len(p) // size) // 2 * size
        parts += [p[half:], p[:half]]
    return np.concatenate([np.zeros(0, np.int64), *done])


class Index:
    """Exact nearest neighbours by cosine among examples (ids, labels, vectors over terms 0..V-1)."""

    def __init__(self, ids: list, labels: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int):
        n = len(ids)
        ex = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)])
        common = np.argsort(-np.bincount(term, minlength=terms), kind="stable")[:DENSE]
        self.place = np.full(terms, -1, np.int32)
        self.place[common] = np.arange(len(common))
        at = self.place[term]
        dense = np.zeros((n, len(common)))
        dense[ex[at >= 0], at[at >= 0]] = weight[at >= 0]
        self.order = arrange(dense.astype(np.float32), BLOCK)
        self.ids, self.labels = [ids[i] for i in self.order], np.asarray(labels)[self.order]
        self.rank = np.empty(n, np.int64)
        self.rank[sorted(range(n), key=self.ids.__getitem__)] = np.arange(n)
        self.blocks = -(-n // BLOCK)
        self.dense = np.zeros((len(common), self.blocks * BLOCK))
        self.dense[:, :n] = dense[self.order].T
        del dense
        self.most = self.dense.reshape(len(common), self.blocks, BLOCK).max(axis=2) if n else np.zeros((len(common), 0))
        to = np.empty(n, np.int64)
        to[self.order] = np.arange(n)
        self.where = to  # of an example, its column
        ex, term, weight = to[ex[at < 0]], term[at < 0], weight[at < 0]
        by = np.argsort(term, kind="stable")
        self.ex, self.weight = ex[by].astype(np.int32), weight[by]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=terms))])

    def partial(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """For each vector its weights of the commonest terms, and all examples' scores by the other terms."""
        q = np.zeros((len(vectors), len(self.dense)))
        out = np.zeros((len(vectors), self.dense.shape[1]))
        for i, (t, w) in enumerate(vectors):
            at = self.place[t]
            q[i, at[at >= 0]] = w[at >= 0]
            n = self.start[t + 1] - self.start[t]
            if total := int(n.sum()):
                at = np.arange(total) + np.repeat(self.start[t] - np.cumsum(n) + n, n)
                out[i] = np.bincount(self.ex[at], np.repeat(w, n) * self.weight[at], out.shape[1])
        return q, out

    def search(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(examples, cosines) of each vector, best first, only positive cosines; ``without``: an example to leave out for each."""
        if not self.ids:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        q, scores = self.partial(vectors)
        rows = np.arange(len(vectors))
        if without is not None:
            scores[rows, self.where[without]] = -np.inf
        whole = np.zeros((len(vectors), self.blocks), bool)
        bound = scores.reshape(len(vectors), self.blocks, BLOCK).max(axis=2) + q @ self.most

        def complete(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)).tolist():
                at = np.flatnonzero(wanted[:, b])
                scores[at, b * BLOCK : (b + 1) * BLOCK] += q[at] @ self.dense[:, b * BLOCK : (b + 1) * BLOCK]
            whole[wanted] = True

        first = np.zeros_like(whole)
        first[rows[:, None], np.argsort(-bound, axis=1, kind="stable")[:, :FIRST]] = True
        complete(first)
        known = np.where(np.repeat(whole, BLOCK, axis=1), scores, -np.inf)
        least = np.maximum(np.partition(known, -k, axis=1)[:, -k], 0) if known.shape[1] > k else np.zeros(len(vectors))
        complete((bound >= least[:, None] - 1e-9) & (bound > 0) & ~whole)
        out = []
        for i in rows.tolist():
            at = np.flatnonzero((scores[i] > 1e-12) & np.repeat(whole[i], BLOCK) & (scores[i] >= least[i] - 1e-9))
            c = np.round(scores[i, at], 12)
            by = np.lexsort((self.rank[at], -c))[:k]
            out.append((at[by], c[by]))
        return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic curve, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    v = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        g = a.T @ (weight * (p - y)) + ridge * v
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        d = np.linalg.solve(h, g)
        v = v - d
        if np.abs(d).max() < 1e-9:
            break
    return float(v[0]), float(v[1])


def inverse_frequencies(df: np.ndarray, n: float, share: float, toxic_with: np.ndarray) -> np.ndarray:
    """idf among documents that are not toxic: of n documents ``share`` are, of which the shares ``toxic_with`` have the terms."""
    clean = n * (1 - share)
    return np.log((clean + 2) / (np.clip(df - n * share * toxic_with, 0, clean) + 1))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str, id_col: str, text_col: str) -> dict:
    sample, sizes = sample_labels(labels, label_col, learn, EXAMPLES, id_col)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    rows = sampled(docs, sample, id_col, text_col).select(F.col("__sw_id").alias("i"), F.col("label").cast("int").alias("y"), F.col("text").alias("t"))

    def counts(batches):
        for batch in batches:
            ts = texts(batch, "t")
            doc, h = term_hashes(ts)
            by = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[by], np.arange(len(ts) + 1))
            terms = [np.unique(h[by[a:b]], return_counts=True) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x, _ in terms], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in terms], pa.binary())], ["i", "y", "at", "n"])

    got = sorted(((r.i, r.y, np.frombuffer(r.at, np.uint64), np.frombuffer(r.n, np.int32)) for r in rows.mapInArrow(counts, f"{ddl(rows, 'i')}, y int, at binary, n binary").collect()), key=lambda r: r[0])
    y = np.array([r[1] for r in got], np.int64)
    if not len(y) or y.min() == y.max():
        return {"share": share, "index": None}
    known = np.unique(np.concatenate([a for _, _, a, _ in got]))
    v = len(known)

    def frequencies(batches):
        lookup = Lookup(known)
        df = np.zeros(v + DIM + 1, np.int64)
        for batch in batches:
            ts = texts(batch, text_col)
            df[-1] += len(ts)
            for code, _ in term_counts(ts, lookup):
                df[np.unique(np.where(code < int(UNKNOWN), code, v + code % DIM))] += 1
        return df

    df = array_sum(docs.select(text_col), frequencies, np.int64)
    places = [np.searchsorted(known, a) for _, _, a, _ in got]
    toxic_with = np.bincount(np.concatenate([p for p, label in zip(places, y, strict=True) if label]), minlength=v) / y.sum()
    n = float(df[-1])
    model = {"share": share, "known": known, "weight": inverse_frequencies(df[:v], n, share, toxic_with) ** POWER, "other": inverse_frequencies(df[v:-1], n, share, np.zeros(DIM)) ** POWER}
    vectors = [vector((p, c), model) for p, (_, _, _, c) in zip(places, got, strict=True)]
    model["index"] = Index([r[0] for r in got], y, vectors, v)
    votes = np.array([x for x, _, _ in votes_of(model["index"], vectors, list(range(len(vectors))))])
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    model["curve"] = logistic(votes, y, weight)
    return model


def vector(counts: tuple[np.ndarray, np.ndarray], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(places among the examples' terms, weights); the norm is 1 over all terms of the text, also those that no example has."""
    at, n = counts
    known = at < int(UNKNOWN)
    w = (1 + np.log(n)) * np.concatenate([model["weight"][at[known]], model["other"][at[~known] % DIM]]) if len(at) else np.zeros(0)
    norm = float(np.sqrt((w * w).sum()))
    return at[known], w[: int(known.sum())] / (norm or 1.0)


def votes_of(index: Index, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None):
    """(vote, examples, cosines) of each vector; ``without``: an example for each vector that is left out."""
    for i in range(0, len(vectors), QUERIES):
        for at, cos in index.search(vectors[i : i + QUERIES], NEIGHBOURS, None if without is None else without[i : i + QUERIES]):
            yield float((cos * index.labels[at]).sum() / (cos.sum() + DOUBT)), at, cos


def score(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep`` (the id, by default), score and evidence (doc_id, cosine, label) for every row of docs.

    ``learn`` is a condition on labels. The index (EXAMPLES documents) is broadcast.
    """
    keep = keep if keep is not None else {id_col: F.col(id_col)}
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, learn, label_col, id_col, text_col))
    src = docs.select(F.col(text_col).alias("__sw_text"), *[c.alias(n) for n, c in keep.items()])
    names = list(keep)
    item = pa.struct([("doc_id", arrow_type(docs, id_col)), ("cosine", pa.float64()), ("label", pa.int32())])
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        index = m["index"]
        lookup = Lookup(m["known"]) if index else None
        for batch in batches:
            out, why = [], []
            if index is None:
                out, why = [m["share"]] * batch.num_rows, [[]] * batch.num_rows
            else:
                a, b = m["curve"]
                for v, at, cos in votes_of(index, [vector(c, m) for c in term_counts(texts(batch, "__sw_text"), lookup)]):
                    out.append(float(1 / (1 + np.exp(-(a * v + b)))))
                    why.append([{"doc_id": index.ids[i], "cosine": c, "label": y} for i, c, y in zip(at.tolist(), cos.tolist(), index.labels[at].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.float64()), pa.array(why, pa.list_(item))], [*names, "score", "evidence"])

    return src.mapInArrow(run, f"{ddl(src, *names)}, score double, evidence array<struct<doc_id:{kind},cosine:double,label:int>>")
