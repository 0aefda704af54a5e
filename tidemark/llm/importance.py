"""Importance resampling of raw text towards a target.

Method: hashed word n-grams (n = 1, 2) of lower-cased text are counted in ``1 << BITS`` buckets, once over the target texts
and once over all raw texts; with additive smoothing each is a bag-of-n-grams generative model.  The log importance weight
of a text is the sum of log p_target - log p_raw over its n-grams.  Adding standard Gumbel noise and taking the k
largest samples k texts without replacement in proportion to the weights.

The raw model is counted over all texts, the target model over the target texts given; ``labelled_target`` takes at most
``TARGET`` labelled texts for that (documented bound).  The tables have a fixed size.  The k-th largest key is found by four counting
passes over 16 bits of the key each, so the cut is exact, nothing is sorted and nothing grows on the driver.  The noise is a
hash of seed, key and text, so that a repeated task draws it again.

Defined results: null and empty texts have no n-grams and weight 0; without target texts all weights are 0 and the
sample is uniform; repeated rows draw the same noise, and rows that tie with the k-th all stay; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.llm import bytetext as bt
from tidemark.llm.textmap import over_texts, total_counts
from tidemark.sources.workspace import materialise

BITS = 16
ORDERS = (1, 2)
#: Most labelled texts that the target model of ``labelled_target`` is counted on.
TARGET = 20_000


def labelled_target(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TARGET, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` of the documents with label 1, in the order of a hash of the key; null keys and labels are left out."""
    ids = labels.where((F.col(label) == 1) & F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(rows)
    return docs.join(F.broadcast(ids), key, "left_semi")  # a bounded number of keys


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram."""
    words = bt.split(texts, lower=True)
    h = words.hashes()
    found = [bt.windows(words, n, h) for n in ORDERS]
    return np.concatenate([w >> np.uint64(64 - BITS) for w, _, _ in found]).astype(np.int64), np.concatenate([d for _, _, d in found])


def counts(df: DataFrame, text: str) -> np.ndarray:
    """n-grams of all texts in each bucket."""
    return total_counts(df, text, 1 << BITS, lambda texts: np.bincount(grams(texts)[0], minlength=1 << BITS)).astype(float)


def model(raw: DataFrame, target: DataFrame, text: str = "text", smoothing: float = 1.0) -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    t, r = counts(target, text), counts(raw, text)
    if not t.sum():
        return np.zeros(1 << BITS)
    p = lambda c: np.log(c + smoothing) - np.log(c.sum() + smoothing * len(c))
    return p(t) - p(r)


def _ordered(v: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles."""
    i = np.asarray(v, np.float64).view(np.int64)
    return np.where(i < 0, i ^ np.int64(0x7FFFFFFFFFFFFFFF), i)


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, exactly, from four tables of at most 65,536 counts; None if there are fewer."""
    shown = df.select(F.col(column).alias("x"))
    for level in range(4):
        part = F.shiftright("x", 48) if level == 0 else F.shiftright("x", 48 - 16 * level).bitwiseAND(F.lit(0xFFFF))  # the first keeps the sign
        n = sorted(((r["p"], r["n"]) for r in shown.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()), reverse=True)
        for p, c in n:
            if k <= c:
                break
            k -= c
        else:
            return None
        value = p if level == 0 else value << 16 | p  # noqa: F821
        shown = shown.where(part == p)
    return value


def resample(raw: DataFrame, target: DataFrame, share: float, text: str = "text", key: str = "doc_id", seed: int = 11) -> DataFrame:
    """key, n_grams, log_weight, gumbel_key and kept: whether the row is among the ceil(share x rows) sampled."""
    ratio = model(raw, target, text)

    def work(texts):
        b, doc = grams(texts)
        words = bt.split(texts)
        return [np.bincount(doc, minlength=len(texts)), np.bincount(doc, weights=ratio[b], minlength=len(texts)).astype(float),
                bt.signed(bt.run_hashes(bt._BYTE_CODE[words.data], words.offsets[:-1], words.offsets[1:], bt._BASE))]
    scored = over_texts(raw, text, [key], "n_grams bigint, log_weight double, _t bigint", lambda: work)

    @pandas_udf("double")
    def gumbel(h):
        u = ((bt.mix(h.to_numpy().view(np.uint64)) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
        return h.__class__(-np.log(-np.log(u)))

    @pandas_udf("bigint")
    def ordered(v):
        return v.__class__(_ordered(v.to_numpy()))
    drawn = scored.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.xxhash64(F.lit(seed), key, "_t")))
    table = materialise(drawn.withColumn("_o", ordered("gumbel_key")).drop("_t"), "weights")
    cut = kth_largest(table, "_o", max(1, math.ceil(share * table.count())))
    return table.withColumn("kept", F.lit(True) if cut is None else F.col("_o") >= cut).drop("_o")
