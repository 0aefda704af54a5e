"""Where intermediate tables go.

On a cluster the folder named by ``spark.checkpoint.dir`` is shared by all executors and
outlives any of them; it is read from the session.  Only where it is unset on a local master
(tests on one machine) is a fresh temporary folder made and recorded in the context.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    base = spark.conf.get(_KEY, None) or context.getConf().get(_KEY) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_KEY} to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="run-tidemark-"))
        base = context.getCheckpointDir()
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path no other run uses, below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once, read back: cuts lineage and survives executor loss."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
