"""Approximate nearest neighbours by shifted space-filling curves.

Method: vectors are projected onto a few random orthonormal directions and shifted by a random offset, once for each curve;
the Hilbert key of the projected point orders all rows, and near rows are mostly near in some order.  Spark numbers the
rows along each curve and cuts it into segments of ``SEGMENT`` rows; a query meets the rows at most ``width`` places away on each
curve.  The windows of all curves are merged and ranked by the exact distance on the original vectors.

The width is a function of a measured recall, at every size of the table alike: for ``PROBES`` points the true nearest ones are
found by one pass over all rows, and the width is the least with which the share ``recall`` of them lies in a window of
some curve.  On vectors without structure a window of the needed recall is a share of the table, so the work of a query
grows with it there; with structure it does not.

A segment holds each row as 8-bit numbers with its own scale and its rounding error, so that a curve costs a quarter of the
vectors.  Distances from them have exact bounds; whatever may be among the k nearest of a window goes on, and the
survivors of all windows, some tens a query, are measured on the original vectors.

The index is fitted on a bounded sample (``SAMPLE`` vectors: means and principal directions only) and holds every row.
Equal vectors are one point with its smallest ids: of more than k + 1 equal vectors only the k + 1 smallest ids can be among
anyone's k nearest (ties go to the smaller id), so nothing is lost and a vector that a third of all rows share is one row.  Equal
queries are one query, whose result is given to each of their ids.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite numbers take no part;
repeated ids are candidates each, a query never finds its own id; fewer than k candidates give as many rows as there are;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.sources.workspace import materialise

SAMPLE = 5000
CURVES, DIMENSIONS, DEPTH = 40, 10, 6
#: Rows of a segment of a curve: what one group holds.
SEGMENT = 4096
#: Share of the true neighbours of the probed points that the windows must hold, and points probed for it.
RECALL, PROBES = 0.96, 200


def hilbert_keys(cells: np.ndarray, depth: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points with ``depth`` bits for each coordinate (at most 63 bits in all).

    From the highest bit down, coordinates are reflected and exchanged so that the next bits are read in the frame
    of the sub-cube; the bits are then Gray-decoded across the coordinates.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(depth - 1, 0, -1):
        bit, below = np.int64(1) << level, (np.int64(1) << level) - 1
        for i in range(n):
            up = x[i] & bit > 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(up, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(depth - 1, 0, -1):
        flip = np.where(x[n - 1] & (np.int64(1) << level) > 0, flip ^ ((np.int64(1) << level) - 1), flip)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(depth - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> level & 1)
    return key


def clean(df: DataFrame, vector: str, key: str) -> DataFrame:
    """key, v (an array as it is in the table): the rows that take part."""
    v = F.col(vector)
    usable = v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    return df.select(key, v.alias("v")).where(F.col(key).isNotNull()).where(usable)


def width_for(points: DataFrame, placed: DataFrame, probes: list, k: int, recall: float) -> int:
    """Places on either side within which the share ``recall`` of the probes' k nearest points lie on some curve."""
    if not probes:
        return 1
    names, at = np.array([p["point"] for p in probes], np.int64), np.array([p["v"] for p in probes], float)
    square = (at ** 2).sum(1)

    def closest(batches):
        best = np.full((len(at), 0), np.inf), np.zeros((len(at), 0), np.int64)
        for b in batches:
            x = np.asarray(b.column(1).flatten()).astype(float).reshape(-1, at.shape[1])
            ids = np.asarray(b.column(0))
            far = square[:, None] + (x ** 2).sum(1) - 2 * at @ x.T
            far[names[:, None] == ids] = np.inf
            far, ids = np.concatenate([best[0], far], 1), np.concatenate([best[1], np.broadcast_to(ids, far.shape)], 1)
            if far.shape[1] > k:
                least = np.argpartition(far, k - 1, 1)[:, :k]
                far, ids = np.take_along_axis(far, least, 1), np.take_along_axis(ids, least, 1)
            best = far, ids
        some = np.isfinite(best[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(names[:, None], some.shape)[some]), pa.array(best[1][some]), pa.array(best[0][some])], names=["probe", "near", "far"])
    pairs = points.select("point", "v").mapInArrow(closest, "probe bigint, near bigint, far double")
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy("far", "near"))).where(F.col("r") <= k)
    here = pairs.join(placed.select(F.col("point").alias("probe"), "curve", F.col("no").alias("here")), "probe")
    there = here.join(placed.select(F.col("point").alias("near"), "curve", "no"), ["near", "curve"])
    gaps = sorted(r["gap"] for r in there.groupBy("probe", "near").agg(F.min(F.abs(F.col("here") - F.col("no"))).alias("gap")).collect())  # at most PROBES x k
    return max([1, *gaps[:int(np.ceil(recall * len(gaps)))][-1:]])


def packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit numbers of each row, the row's scale, and a bound of the distance between the row and what they stand for."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    small = np.rint(x / scale[:, None]).astype(np.int8)
    return small, scale, np.sqrt(((x - small * scale[:, None]) ** 2).sum(1)) * (1 + 1e-9) + 1e-12 * scale


def search(df: DataFrame, queries, k: int = 10, vector: str = "embedding", key: str = "vec_id", curves: int = CURVES, segment: int = SEGMENT, seed: int = 7, recall: float = RECALL, width: int | None = None) -> DataFrame:
    """query_id, rank, key, score: for each row with ``queries`` (a Column) its k nearest other rows, nearest first.

    A given ``width`` replaces the measured one."""
    rows = clean(df, vector, key)
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head()
    schema = f"query_id bigint, {key} bigint, score double"
    if common is None:
        return df.sparkSession.createDataFrame([], schema).selectExpr("query_id", "cast(0 as int) AS rank", key, "score")
    d = common["d"]
    rows = rows.where(F.size("v") == d)
    fitted = np.array([r["v"] for r in rows.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("v").toLocalIterator()])
    mean = fitted.mean(0)
    _, spread, axes = np.linalg.svd(fitted - mean, full_matrices=False)
    rng, m = np.random.default_rng(seed), min(DIMENSIONS, d)
    frames = []
    for c in range(curves):
        # random directions, drawn with the spread of the data so that most of each vector's variation is seen
        shape = (axes.T * (spread + 1e-9)) @ rng.standard_normal((len(axes), m))
        q, _ = np.linalg.qr(shape if shape.shape[0] >= m else rng.standard_normal((d, m)))
        p = (fitted - mean) @ q
        span = np.maximum(p.max(0) - p.min(0), 1e-9)
        frames.append((q, p.min(0) - span * rng.random(m), 2 * span))

    points = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy(key))).where(F.col("r") <= k + 1)
    ids = points.groupBy("v").agg(F.sort_array(F.collect_list(key)).alias("ids"))  # at most k + 1 ids
    points = materialise(ids.withColumn("point", F.xxhash64("v")), "points")

    @pandas_udf("array<bigint>")
    def curve_keys(v):
        x = np.stack(v.to_numpy()).astype(float) - mean
        out = [hilbert_keys(np.clip((x @ q - low) / span * (1 << DEPTH), 0, (1 << DEPTH) - 1).astype(np.int64), DEPTH) for q, low, span in frames]
        return v.__class__(list(np.stack(out, 1)))

    filed = points.select("point", F.posexplode(curve_keys("v")).alias("curve", "place"))
    # numbers along each curve: buckets of the key (a pure function of it), counts before, places within
    filed = materialise(filed.withColumn("bucket", F.shiftright("place", max(0, m * DEPTH - 16))), "curve")
    counts = filed.groupBy("curve", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("curve", "bucket", (F.sum("n").over(Window.partitionBy("curve").orderBy("bucket")) - F.col("n")).alias("before"))
    numbered = filed.join(before, ["curve", "bucket"]).withColumn("no", F.col("before") + F.row_number().over(Window.partitionBy("curve", "bucket").orderBy("place", "point")) - 1)
    placed = materialise(numbered.select("point", F.col("curve").cast("int").alias("curve"), F.col("no").cast("long").alias("no")), "placed")
    if width is None:
        width = width_for(points, placed, points.orderBy(F.xxhash64("point"), "point").limit(PROBES).select("point", "v").collect(), k, recall)
    asks = rows.where(queries).select(F.col(key).alias("query_id"), F.xxhash64("v").alias("point")).distinct()
    own = points.join(asks.select("point").distinct(), "point").select("point", "v")
    asking = own.join(placed, "point").select("curve", "no", F.col("point").alias("query"), F.col("v").alias("qv"), F.explode(F.sequence(F.floor(F.greatest(F.col("no") - width, F.lit(0)) / segment), F.floor((F.col("no") + width) / segment))).alias("part"))

    def shrink(batches):
        for b in batches:
            x = np.asarray(b.column(1).flatten()).astype(float).reshape(-1, d)
            small, scale, error = packed(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in small], pa.binary()), pa.array(scale), pa.array(error)], names=["point", "small", "scale", "error"])
    short = points.select("point", "v").mapInArrow(shrink, "point bigint, small binary, scale double, error double")
    members = placed.join(short, "point").select(F.col("curve").alias("c"), F.floor(F.col("no") / segment).alias("p"), F.col("no").alias("there"), F.col("point").alias("near"), "small", "scale", "error")

    def windows(keys, left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if len(left) and len(right):
            no = np.asarray(right.column("there").combine_chunks())
            order = np.argsort(no)
            no, names = no[order], np.asarray(right.column("near").combine_chunks())[order]
            scale, error = (np.asarray(right.column(c).combine_chunks())[order] for c in ("scale", "error"))
            x = np.frombuffer(b"".join(right.column("small").to_pylist()), np.int8).reshape(-1, d)[order].astype(np.float32) * scale[:, None].astype(np.float32)
            square = (x.astype(float) ** 2).sum(1)
            at = np.asarray(left.column("no").combine_chunks())
            q = np.asarray(left.column("qv").combine_chunks().flatten()).astype(float).reshape(len(left), d)
            lo, hi = np.searchsorted(no, at - width), np.searchsorted(no, at + width, "right")
            for i, name in enumerate(left.column("query").to_pylist()):
                a, z = lo[i], hi[i]
                if a == z:
                    continue
                far = square[a:z] - 2 * (x[a:z] @ q[i].astype(np.float32)).astype(float) + q[i] @ q[i]
                slack = error[a:z] + 1e-5 * (np.sqrt(square[a:z]) + np.sqrt(q[i] @ q[i]))  # rounding of the products included
                far = np.sqrt(np.maximum(far, 0))
                least, most = far - slack - np.sqrt(1e-6 * (square[a:z] + q[i] @ q[i])), far + slack + np.sqrt(1e-6 * (square[a:z] + q[i] @ q[i]))
                limit = np.partition(most, min(k, z - a - 1))[min(k, z - a - 1)]
                near = np.flatnonzero(least <= limit)
                for column, values in zip(out, ([name] * len(near), names[a:z][near], least[near], most[near])):
                    column.append(np.asarray(values))
        kinds = (np.int64, np.int64, float, float)
        return pa.table({c: pa.array(np.concatenate(v) if v else np.zeros(0, t)) for c, v, t in zip(("query", "point", "least", "most"), out, kinds)})
    met = asking.groupBy("curve", "part").cogroup(members.groupBy("c", "p")).applyInArrow(windows, "query bigint, point bigint, least double, most double")
    # a point met on several curves counts once; a query keeps what its k + 1 nearest points may be (its own vector is one of them)
    met = met.groupBy("query", "point").agg(F.max("least").alias("least"), F.min("most").alias("most"))
    w = Window.partitionBy("query").orderBy("most", "point")  # some tens of points a curve
    met = met.withColumn("limit", F.nth_value("most", k + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("limit IS NULL OR least <= limit")

    @pandas_udf("double")
    def distance(v, q):
        x, y = np.stack(v.to_numpy()).astype(float), np.stack(q.to_numpy()).astype(float)
        return v.__class__(np.sqrt(((x - y) ** 2).sum(1)))
    near = met.select("query", "point").join(points, "point").join(own.select(F.col("point").alias("query"), F.col("v").alias("qv")), "query").select("query", "ids", distance("v", "qv").alias("score"))
    listed = near.select("query", "score", F.explode("ids").alias(key))
    first = listed.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", key))).where(F.col("r") <= k + 1)
    lists = first.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", F.col(key).alias("id")))).alias("near"))  # k + 1 entries
    # every id of a query's vector gets its list, less itself
    answers = asks.join(lists, asks["point"] == lists["query"]).select("query_id", F.posexplode(F.slice(F.filter("near", lambda e: e["id"] != F.col("query_id")), 1, k)).alias("rank", "e"))
    return answers.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("e.id").alias(key), F.col("e.score").alias("score"))
