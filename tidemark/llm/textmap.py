"""Arrow maps over whole texts: the one way in which the operators of this package leave the JVM."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm import bytetext as bt


def worker_cache(key: str, make: Callable):
    """An object that a Python worker keeps from task to task (models, vocabularies)."""
    kept = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def trim() -> None:
    """Give freed memory back to the system; workers stay alive between tasks and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


def fields(ddl: str) -> list[StructField]:
    return StructType.fromDDL(ddl).fields


def over_texts(df: DataFrame, text: str, keep: list[str], new: str, prepare: Callable[[], Callable[..., list]], beside: tuple[str, ...] = (), limit: int = bt.SLICE) -> DataFrame:
    """Columns ``keep`` and the columns of DDL ``new``, which prepare()(texts) gives for each slice of whole texts.

    Columns ``beside`` are read and given to that function after the texts, and are not returned.
    A kept column with the name of a new one gives way to it; other columns of ``df`` are not read.
    """
    added = fields(new)
    keep = [c for c in dict.fromkeys(keep) if c not in {f.name for f in added}]
    schema = StructType([df.schema[c] for c in keep] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added]
        work = None
        for b in batches:
            work = work or prepare()
            texts = b.column(len(keep))
            for lo, hi in bt.slices(texts, limit):
                arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in work(*(c.slice(lo, hi - lo) for c in b.columns[len(keep):]))]
                arrays = [x if x.type == k else x.cast(k) for x, k in zip(arrays, kinds)]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(len(keep))), *arrays], names=schema.names)
                arrays = None
            texts = None
            trim()
    return df.select(*(df[c] for c in keep), df[text].cast("string").alias("__text"), *(df[c].alias(f"__{c}") for c in beside)).mapInArrow(run, schema)


def total_counts(df: DataFrame, text: str, size: int, count: Callable[..., np.ndarray], beside: tuple[str, ...] = (), limit: int = bt.SLICE) -> np.ndarray:
    """Sum of count(texts, ...), an array of ``size`` numbers, over all texts: a task adds up its slices and sends one table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for lo, hi in bt.slices(b.column(0), limit):
                total += count(*(c.slice(lo, hi - lo) for c in b.columns))
            trim()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["b", "n"])
    tables = df.select(df[text].cast("string").alias("__text"), *(df[c].alias(f"__{c}") for c in beside)).mapInArrow(run, "b bigint, n bigint")
    rows = tables.groupBy("b").agg(F.sum("n").alias("n")).toArrow()  # at most ``size`` rows
    out = np.zeros(size, np.int64)
    out[np.asarray(rows.column("b"))] = np.asarray(rows.column("n"))
    return out


def lists(values, offsets) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))
