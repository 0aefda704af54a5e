"""A bounded, repeatable sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(key: str = "doc_id") -> Column:
    """One row in five, by checksum of the key as text; such rows never take part in learning."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(key, label, text) of at most ``rows`` labelled documents of each class, and the size of both classes.

    Rows are taken in the order of a hash of the key. Held-out rows, null labels and null keys are left out; a key with
    several labels counts with the largest, one with several texts with each of them.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    known = known.join(docs.select(key), key, "left_semi")
    sizes = {0: 0, 1: 0} | {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(key)
    parts = [known.where(F.col("label") == c).orderBy(order, key).limit(rows) for c in (0, 1)]
    chosen = parts[0].unionAll(parts[1])
    return docs.select(key, text).join(F.broadcast(chosen), key), sizes  # at most 2 x rows keys
