"""Scans over a globally sorted table without gathering any group.

``ranged`` deals rows out by ranges of a total order and gives every task its whole sorted range as numpy-ready Arrow.  What
crosses a boundary (a count, a running value, the next row) is worked out on the driver from one summary row for each range,
and given back to the rows by ``carried``.  A range holds about ``rows`` rows, however large a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from tidemark.llm.textmap import trim
from tidemark.sources.workspace import materialise

ROWS = 200_000


def ranged(df: DataFrame, order: list[str | Column], schema: str, work: Callable[[pa.Table], dict], label: str, rows: int | None = None) -> DataFrame:
    """work(sorted range) for every range, with its number as part; written once.  An empty range gives nothing."""
    session = df.sparkSession
    kinds = StructType.fromDDL(schema + ", part int")
    n = max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (rows or ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        got = [b for b in batches if b.num_rows]
        if got:
            out = work(pa.Table.from_batches(got))
            size = len(next(iter(out.values())))
            out["part"] = [TaskContext.get().partitionId()] * size
            yield from pa.table([pa.array(out[f.name], f.type) if not isinstance(out[f.name], (pa.Array, pa.ChunkedArray)) else out[f.name].cast(f.type) for f in arrow], schema=arrow).to_batches(max_chunksize=50_000)
        trim()
    return materialise(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, kinds), label)


def carried(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Join what the driver worked out for each range (one row a range) to the rows of that range."""
    if not rows:
        return df.join(df.sparkSession.createDataFrame([], "part int, " + schema), "part", "left")
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, "part int, " + schema)), "part", "left")
