"""Neighbour search against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hilbert


def brute(rows, k, asked):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None]
    out = {}
    for i, v in rows:
        if asked(i):
            out[i] = sorted((float(np.sqrt(((x - v) ** 2).sum())), j) for j, x in rows if j != i)[:k]
    return out


def found(df, k=10, **more):
    out = {}
    for r in hilbert.search(df, F.col("vec_id") % 5 == 0, k, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_small_tables_go_through_the_curves_too(spark):
    """Equal vectors, of queries as well, are found in order; a window of two places on one curve cannot find everything."""
    r = np.random.default_rng(0)
    rows = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(200, 16)).astype(np.float32))] + [(1000 + i, [1.0] * 16) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, 10, lambda i: i % 5 == 0)
    assert found(df, width=1000) == want
    narrow, wide = (share(found(df, **kw), want) for kw in ({"curves": 1, "width": 2}, {}))
    assert narrow < 0.5 and wide >= 0.9


def share(got, want):
    return sum(len({j for _, j in got.get(q, [])} & {j for _, j in want[q]}) for q in want) / sum(len(v) for v in want.values())


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (5, [0.9, 0.1]), (6, None), (7, [0.0, 0.0]), (10, [float("nan"), 1.0]), (15, [float("inf"), 1.0]), (20, [None, 1.0]), (25, []), (None, [1.0, 1.0]), (3, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    assert found(df) == brute([(0, [1.0, 0.0]), (5, [0.9, 0.1]), (3, [0.5, 0.5])], 10, lambda i: i % 5 == 0)
    assert found(df.where("vec_id = 6")) == {} and found(df.where("vec_id = 0")) == {}


def test_recall_with_small_blocks(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 32)) * 3
    rows = [(i, v.tolist()) for i, v in enumerate(centres[r.integers(0, 20, 3000)] + r.normal(size=(3000, 32)))]
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), segment=64), brute(rows, 10, lambda i: i % 5 == 0)
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("spread, curves", [(0, 4), (3, 6)])
def test_recall_holds_with_few_curves_and_small_segments(spark, spread, curves):
    r = np.random.default_rng(4)
    centres = r.normal(size=(40, 24)) * spread
    rows = [(i, v.tolist()) for i, v in enumerate(centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 24)))]
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), curves=curves, segment=32), brute(rows, 10, lambda i: i % 5 == 0)
    hits = sum(len({j for _, j in got[q]} & {j for _, j in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("n, depth", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_order_visits_neighbouring_cells(n, depth):
    cells = np.stack(np.meshgrid(*[np.arange(1 << depth)] * n, indexing="ij"), -1).reshape(-1, n)
    key = hilbert.hilbert_keys(cells, depth)
    assert sorted(key.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()
