"""Snapshots that are replaced by one atomic step.

A snapshot is a folder with ``data/<version>`` folders and ``_commits/<version>`` markers.  A version is written in full,
then its marker is created, which is the commit; readers take the highest marker.  No file that a reader may have
found is moved, and superseded versions are deleted only when they were replaced longer ago than a grace period, so a running
read ends on the version it began with.  A plain Parquet folder without markers reads as itself.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _commits(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(version, time of commit) in order of version."""
    fs, at = _fs(spark, f"{path}/_commits/*")
    return sorted((f.getPath().getName(), f.getModificationTime()) for f in fs.globStatus(at) or [])


def current(spark: SparkSession, path: str) -> str:
    """Folder of the committed version; the path itself where nothing was committed."""
    done = _commits(spark, path)
    return f"{path}/data/{done[-1][0]}" if done else path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a version is committed, or a plain folder stands there."""
    if _commits(spark, path):
        return True
    (fs, at), (_, data) = _fs(spark, path), _fs(spark, f"{path}/data")
    return fs.exists(at) and not fs.exists(data)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path))


def write(df: DataFrame, path: str, grace_seconds: float = 3600.0) -> str:
    """Write a version, commit it, and delete what was replaced longer ago than the grace period. Returns the version."""
    spark = df.sparkSession
    done = _commits(spark, path)
    version = f"{int(done[-1][0].split('-')[0]) + 1 if done else 0:012d}-{uuid.uuid4().hex}"
    df.write.option("compression", "snappy").parquet(f"{path}/data/{version}")
    fs, marker = _fs(spark, f"{path}/_commits/{version}")
    fs.create(marker, False).close()  # fails where it exists; seen in full or not at all
    clean(spark, path, grace_seconds)
    return version


def clean(spark: SparkSession, path: str, grace_seconds: float = 3600.0) -> list[str]:
    """Delete versions whose successor was committed before the grace period, markers first."""
    done = _commits(spark, path)
    now, gone = spark._jvm.java.lang.System.currentTimeMillis(), []
    for (version, _), (_, replaced) in zip(done, done[1:]):
        if replaced + grace_seconds * 1000 <= now:
            for part in ("_commits", "data"):
                fs, at = _fs(spark, f"{path}/{part}/{version}")
                fs.delete(at, True)
            gone.append(version)
    return gone
