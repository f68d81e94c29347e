"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of anything but letters become one space, and n-grams of 1 to 4 characters are hashed into
DIM features. Document frequencies are counted over all learning documents. The model is trained by
follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a bounded sample (SAMPLE documents,
about equally many of each language, all of whose text is used), and its temperature is fitted on a part of the sample
that training does not see. The model is DIM x languages numbers, of which the L1 penalty leaves few.

Nulls and odd inputs: a null text and one without letters gives ``und`` and score 0. Documents with a null language are
not learned from. Without learning documents everything is ``und``; with one language only, all that has letters gets
it, with score 1. Repeated documents get a row each; empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import array_sum, mix64, unit_hash

GRAMS = (1, 2, 3, 4)
DIM = 1 << 15
#: Documents that the model is trained on, at most (in expectation), and of one language at least.
SAMPLE, LEAST = 3000, 40
#: Characters that are hashed at once.
CHUNK = 1 << 20
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 4
UND = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(features, counts) of a text; None if it has no letter."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[code]
    if not letter.any():
        return None
    code = np.where(letter, code, np.uint32(32))
    keep = letter | np.concatenate([[True], letter[:-1]])
    code = np.concatenate([[np.uint32(32)], code[keep], [np.uint32(32)]]).astype(np.uint64)
    counts = np.zeros(DIM, np.int64)
    for a in range(0, len(code), CHUNK):
        part = code[a : a + CHUNK + GRAMS[-1] - 1]
        here = min(CHUNK, len(code) - a)
        h = np.zeros(len(part), np.uint64)
        for n in range(1, GRAMS[-1] + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(1)
            if n in GRAMS:
                counts += np.bincount((mix64(h[: min(m, here)] + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(64 - 15)).astype(np.int64), minlength=DIM)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(counts: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts
    x = (1 + np.log(n)) * idf[at]
    norm = float(np.sqrt((x * x).sum()))
    return at, x / norm if norm else x


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIM x classes) and biases by FTRL-proximal with L1 and L2 penalties."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    rand = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rand.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weights(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


def fit_temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, on a grid of ratios of 3 percent."""
    best, least = 1.0, np.inf
    for t in 1.03 ** np.arange(-120, 121):
        s = scores / t
        s = s - s.max(axis=1, keepdims=True)
        loss = float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())
        if loss < least - 1e-12:
            best, least = float(t), loss
    return best


def fit(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str) -> dict | None:
    """The model, learned from the rows of docs where ``learn`` holds."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    totals = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return None
    names = sorted(totals)

    def frequencies(batches):
        df = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                c = gram_counts(t)
                if c:
                    df[c[0]] += 1
                    df[DIM] += 1
        return df

    df = array_sum(rows.select("t"), frequencies, np.int64)
    if df is None or not df[DIM]:
        return {"names": names, "idf": np.ones(DIM, np.float32), "w": np.zeros((DIM, len(names)), np.float32), "b": np.log(np.array([totals[x] for x in names], float)), "t": 1.0}
    idf = np.log((1 + df[DIM]) / (1 + df[:DIM])) + 1

    each = max(LEAST, SAMPLE // len(names))
    chance = F.lit(0.0)
    for x in names:
        chance = F.when(F.col("l") == x, min(1.0, each / totals[x])).otherwise(chance)
    sample = rows.filter(unit_hash(F.col("i"), F.col("l")) < chance)

    def features(batches):
        for batch in batches:
            out = [[], [], []]
            for t, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = gram_counts(t)
                if c:
                    for o, v in zip(out, (lang, c[0].astype(np.uint16).tobytes(), c[1].astype(np.int64).tobytes()), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["l", "at", "n"])

    # ordered, so that the model does not depend on how the rows are dealt
    got = sorted((r.l, bytes(r.at), bytes(r.n)) for r in sample.select("t", "l").mapInArrow(features, "l string, at binary, n binary").collect())
    data = [(*vector((np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(n, np.int64)), idf), names.index(x)) for x, a, n in got]
    order = np.random.default_rng(3).permutation(len(data))
    held = [data[i] for i in order[: len(data) // 5]]
    w, b = train([data[i] for i in order[len(data) // 5 :]], len(names))
    t = fit_temperature(np.array([x @ w[at] + b for at, x, _ in held]), np.array([y for _, _, y in held])) if held else 1.0
    return {"names": names, "idf": idf.astype(np.float32), "w": w.astype(np.float32), "b": b, "t": t}


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: dict[str, Column] | None = None) -> DataFrame:
    """The columns ``keep`` (the id, by default), lang_pred and score for every row of docs.

    Learns from rows where ``learn`` holds; predicts from the text alone.
    """
    keep = keep if keep is not None else {id_col: F.col(id_col)}
    model = fit(docs, learn, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM * (languages + 1) numbers
    src = docs.select(F.col(text_col).alias("__sw_text"), *[c.alias(n) for n, c in keep.items()])
    names = list(keep)
    kinds = ", ".join(f"`{n}` {src.schema[n].dataType.simpleString()}" for n in keep)

    def run(batches):
        m = shared.value
        for batch in batches:
            lang, score = [], []
            for t in batch.column(0).to_pylist():
                c = gram_counts(t) if m else None
                if c is None:
                    lang.append(UND)
                    score.append(0.0)
                    continue
                at, x = vector(c, m["idf"])
                s = (x @ m["w"][at] + m["b"]) / m["t"]
                p = np.exp(s - s.max())
                p /= p.sum()
                k = int(np.argmax(p))
                lang.append(m["names"][k])
                score.append(min(1.0, float(p[k])))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return src.mapInArrow(run, f"{kinds}, lang_pred string, score double")
