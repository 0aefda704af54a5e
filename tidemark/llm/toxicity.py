"""Toxicity of whole texts: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Method: a text is the set of its hashed character n-grams (lower case, ``ORDERS`` characters).  From the labelled texts
the ratio r = log((1 + toxic texts with the n-gram) / |toxic|) - log((1 + others with it) / |others|) is counted; each present
n-gram has the value r, and a logistic regression with L2 penalty learns the weights.  N-grams too rare or too even to
tell are not kept, so most of a text costs a table lookup and nothing else.

The fit takes at most ``SAMPLE`` texts of each class (documented bound, in order of a hash of the key); the intercept is
shifted from the even classes of the sample to their shares among all labelled rows.  Only text is an input.

Defined results: null and empty texts have no n-gram and score as the intercept; without labels of both classes all
texts score 0; repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import bytetext as bt, labelled
from tidemark.llm.textmap import lists, over_texts
from tidemark.sources.workspace import materialise

ORDERS = (4, 5, 6)
BITS = 20
_COUNT_SLICE, _SCORE_SLICE = 1 << 19, 1 << 18
#: Most labelled texts of each class that the fit reads.
SAMPLE = 2500


@dataclass
class Model:
    feature: np.ndarray
    weight: np.ndarray
    intercept: float


def grams(texts: pa.Array, tells: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram, text) for each place of each n-gram order; with ``tells`` only of the n-grams it marks."""
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    n = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    data, _ = bt.data_of(texts)
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint32)
    doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
    coded = chars * np.uint32(0x9E3779B1)
    last = np.cumsum(n)[n > 0] - 1
    out, where = [], []
    h = np.zeros(len(chars), np.uint32)
    for k in range(max(ORDERS)):
        m = len(chars) - k
        if m <= 0:
            break
        h = h[:m] * np.uint32(0x01000193) ^ coded[k:]
        if k + 1 in ORDERS:
            x = h + np.uint32(k)
            x = (x ^ x >> np.uint32(16)) * np.uint32(0x85EBCA6B)
            x = (x ^ x >> np.uint32(13)) >> np.uint32(32 - BITS)
            good = np.ones(m, bool) if tells is None else tells[x]
            for back in range(k):  # places from which the n-gram would cross the end of its text
                cross = last - back
                good[cross[(cross >= 0) & (cross < m)]] = False
            at = np.flatnonzero(good)
            out.append(x[at])
            where.append(doc[at])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(out).astype(np.int64), np.concatenate(where)


def present(feature: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, flat, with offsets."""
    u = bt.distinct(doc.astype(np.int64) << BITS | feature)
    return u & (1 << BITS) - 1, np.searchsorted(u, np.arange(n + 1, dtype=np.int64) << BITS)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE, key: str = "doc_id", text: str = "text", steps: int = 80, penalty: float = 2e-3) -> Model | None:
    chosen, sizes = labelled.sample(docs, labels, label, rows, key, text)
    if not all(sizes.values()):
        return None

    chosen = materialise(chosen, "labelled")

    def count(texts, label):
        f, at = present(*grams(texts), len(texts))
        toxic = np.bincount(f[np.repeat(np.asarray(label) == 1, np.diff(at))], minlength=1 << BITS)
        n = np.bincount(f, minlength=1 << BITS)
        some = np.flatnonzero(n)
        ends = np.zeros(len(texts) + 1, np.int64)
        ends[1:] = len(some)
        return [lists(some.astype(np.int32), ends), lists(toxic[some].astype(np.int32), ends), lists(n[some].astype(np.int32), ends)]
    parts = over_texts(chosen, text, [], "f array<int>, t array<int>, n array<int>", lambda: count, beside=("label",), limit=_COUNT_SLICE)
    rows = parts.select(F.explode(F.arrays_zip("f", "t", "n")).alias("x")).groupBy("x.f").agg(F.sum("x.t").cast("int").alias("t"), F.sum("x.n").cast("int").alias("n")).toArrow()  # at most 1 << BITS rows
    toxic, every = np.zeros(1 << BITS), np.zeros(1 << BITS)
    f = np.asarray(rows.column("f"))
    toxic[f], every[f] = np.asarray(rows.column("t")), np.asarray(rows.column("n"))
    n = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    r = np.log((1 + toxic) / (1 + n[1])) - np.log((1 + every - toxic) / (1 + n[0]))
    tells = (every >= max(4, 0.002 * (n[0] + n[1]))) & (np.abs(r) > 0.7)

    def work(texts):
        f, at = present(*grams(texts, tells), len(texts))
        return [lists(f.astype(np.int32), at)]
    table = over_texts(chosen, text, [key, "label"], "f array<int>", lambda: work).orderBy(key).toArrow()  # at most 2 x rows texts, telling n-grams only
    y = np.asarray(table.column("label").combine_chunks()).astype(float)
    sets = table.column("f").combine_chunks()
    i = np.repeat(np.arange(len(y), dtype=np.int32), np.asarray(pc.list_value_length(sets)))
    j = (np.cumsum(tells) - 1)[np.asarray(sets.flatten())].astype(np.int32)
    scale = r[tells]
    w, b = np.zeros(len(scale)), 0.0
    m1, m2, rate = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0.05
    for t in range(1, steps + 1):  # full batches, Adam steps
        p = 1 / (1 + np.exp(-np.clip(np.bincount(i, weights=(w * scale)[j], minlength=len(y)) + b, -50, 50)))
        e = (p - y) / len(y)
        g = np.append(np.bincount(j, weights=e[i], minlength=len(w)) * scale + penalty * w, e.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        d = rate * (m1 / (1 - 0.9 ** t)) / (np.sqrt(m2 / (1 - 0.99 ** t)) + 1e-8)
        w, b = w - d[:-1], b - d[-1]
    shift = np.log(sizes[1] / sizes[0]) - np.log(y.sum() / max(1, len(y) - y.sum()))
    return Model(np.flatnonzero(tells).astype(np.int32), (w * scale).astype(np.float32), float(b + shift))


def score(df: DataFrame, model: Model | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """Columns ``keep`` and the probability of the label."""
    def prepare():
        if model is None:
            return lambda texts: [np.zeros(len(texts))]
        table = np.zeros(1 << BITS, np.float32)
        table[model.feature] = model.weight

        def work(texts):
            f, at = present(*grams(texts, table != 0), len(texts))
            sums = np.append(0, np.cumsum(table[f].astype(float)))
            return [1 / (1 + np.exp(-np.clip(sums[at[1:]] - sums[at[:-1]] + model.intercept, -50, 50)))]
        return work
    return over_texts(df, text, list(keep), f"{name} double", prepare, limit=_SCORE_SLICE)
