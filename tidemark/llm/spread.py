"""A left join that no frequent key gathers into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.sources.workspace import materialise

#: A key with more than this share of the rows is frequent; there are fewer such keys than its reciprocal.
SHARE = 0.001


def left_join(rows: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """rows with the other columns of table, which holds each value of ``on`` at most once.

    Rows of a frequent value stay where they are and meet a broadcast of fewer than 1 / SHARE rows; null has no partner and
    is not shuffled; all other rows meet the table by a shuffle.  ``rows`` is read several times: give a written table.
    """
    counts = materialise(rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("__n")), "frequent")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    frequent = materialise(counts.where(F.col("__n") > SHARE * total).select(on), "frequent")
    known = F.broadcast(frequent.join(table, on, "left"))
    added = [c for c in table.columns if c != on]
    most = rows.where(F.col(on).isNotNull()).join(F.broadcast(frequent), on, "left_anti").join(table, on, "left")
    none = rows.where(F.col(on).isNull()).select("*", *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in added))
    return rows.join(known, on).unionByName(most).unionByName(none).select(*rows.columns, *added)
