"""Sinks: partitioned append, snapshot overwrite, slice replacement, append-unseen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.dedup import unseen
from tidemark.sources import snapshots


def write_partitioned(df: DataFrame, path: str, stamp: str = "fetched_at") -> None:
    """Append below year=/month= of the batch's newest ingestion time (now when there is none).
    Data columns of the same names would be shadowed by the folders, so they are refused."""
    clash = {"year", "month"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} collide with partition folders; rename them")
    newest = df.agg(F.max(F.col(stamp).cast("timestamp_ntz"))).first()[0] if stamp in df.columns else None
    at = F.lit(newest) if newest is not None else F.current_timestamp()
    (df.withColumn("year", F.date_format(at, "yyyy")).withColumn("month", F.date_format(at, "MM"))
       .write.mode("append").partitionBy("year", "month").option("compression", "snappy").parquet(path))


def write_snapshot(df: DataFrame, path: str, cluster: list[str] | None = None, partitions: int | None = None, grace_seconds: float = 3600.0) -> None:
    """Curated snapshot clustered for row-group pruning, committed in one step (``snapshots``): readers see the version before
    or this one, never none."""
    if cluster:
        cols = [F.col(c) for c in cluster]
        df = (df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)).sortWithinPartitions(*cols)
    snapshots.write(df, path, grace_seconds)


def replace_slice(df: DataFrame, path: str, slice_col: str) -> None:
    """Replace only the slices present in df; other partitions stay."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(slice_col).parquet(path))


def append_unseen(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append rows whose key the target lacks (anti join first, then one append)."""
    unseen(df, df.sparkSession.read.parquet(path), keys).write.mode("append").parquet(path)


def replace_from(spark: SparkSession, source: str, target: str) -> bool:
    """Full replacement from another snapshot; True when the schema changed."""
    new = snapshots.read(spark, source)
    changed = not snapshots.exists(spark, target) or snapshots.read(spark, target).schema != new.schema  # an absent target counts as changed
    write_snapshot(new, target)
    return changed
