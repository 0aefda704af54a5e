"""Structured Streaming versions of position deduplication, enrichment, zone summaries and
latest-per-key upserts.  Transformations take a stream or a batch alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.dedup import keep_latest
from tidemark.operators.joins import zone_of
from tidemark.operators.landing import vessel_type
from tidemark.sources.workspace import fresh_path


def file_stream(spark: SparkSession, directory: str, pattern: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """A stream of files; a micro-batch takes at most ``files_per_trigger`` of them."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def drain(stream: DataFrame, mode: str = "append", target: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process what is available and return the result as a table.  Each batch is written under its own
    id (a replayed batch overwrites itself), so the sink is exactly-once.  With ``target`` and ``checkpoint`` of an
    earlier call the stream goes on where that one stopped; without them both are new folders."""
    spark = stream.sparkSession
    out, ckpt = target or fresh_path(spark, "stream-out"), checkpoint or fresh_path(spark, "stream-ckpt")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.option("basePath", out).schema(_plus_batch(stream)).parquet(out)


def _plus_batch(stream: DataFrame):
    from pyspark.sql import types as T
    return T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema] + [T.StructField("batch_id", T.LongType())])


def latest_update(table: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted row per key of an update-mode output."""
    return keep_latest(table, keys, ["batch_id"]).drop("batch_id")


def dedup_positions(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str = "2 hours") -> DataFrame:
    """First row per key within the watermark; state older than the delay is dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def enrich_positions(stream: DataFrame, vessels: DataFrame, keep_types: list[str]) -> DataFrame:
    """Stream-static left join with vessel metadata; a vessel of unknown type passes the filter."""
    j = stream.join(vessels, "mmsi", "left").withColumn("vessel", F.when(F.col("static_type").isNotNull(), vessel_type(F.col("static_type"))))
    return j.where(F.col("vessel").isNull() | F.col("vessel").isin(keep_types))


def tag_zones(stream: DataFrame) -> DataFrame:
    return stream.withColumn("zone", zone_of(F.col("lat"), F.col("lon")))


def zone_windows(stream: DataFrame, width: str = "1 hour", slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Per event-time window, zone and vessel the sums of its reports; ``zone_summary`` makes the report of them.  Counts
    by vessel keep distinct vessels exact; the watermark bounds the state to the vessels of the open windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (stream.withWatermark("ts", delay).groupBy(w.alias("w"), "zone", "mmsi")
            .agg(F.count("*").alias("n"), F.sum("speed").alias("speed"), F.count("speed").alias("n_speed"), F.count_if(F.col("nav_status") == "Under way").alias("under_way"), F.count("nav_status").alias("n_status"))
            .select(F.col("w.start").alias("window_start"), "zone", "mmsi", "n", "speed", "n_speed", "under_way", "n_status"))


def zone_summary(parts: DataFrame) -> DataFrame:
    """(window_start, zone): reports, exact distinct vessels, mean speed and share under way."""
    total = lambda c: F.sum(c)
    return parts.groupBy("window_start", "zone").agg(
        total("n").alias("position_reports"), F.count("mmsi").alias("vessels"), (total("speed") / F.nullif(total("n_speed"), F.lit(0))).alias("avg_speed"),
        (100 * total("under_way") / F.nullif(total("n_status"), F.lit(0))).alias("pct_underway"))


def _current(spark: SparkSession, target: str, before: int | None = None) -> dict[int, str]:
    """Folder of the newest version of each bucket (below version ``before``); at most as many as there are buckets."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/bucket=*/version=*")
    found: dict[int, tuple[int, str]] = {}
    for f in at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at) or []:
        path = f.getPath().toString()
        bucket, version = (int(x.split("=")[1]) for x in path.split("/")[-2:])
        if (before is None or version < before) and version > found.get(bucket, (-1, ""))[0]:
            found[bucket] = (version, path)
    return {b: p for b, (_, p) in found.items()}


def upsert_latest(stream: DataFrame, keys: list[str], recency: list[str], target: str, checkpoint: str | None = None, buckets: int = 32) -> DataFrame:
    """Append-only feed to a latest-per-key table, kept in hash buckets of the key.  A micro-batch is reduced to its newest
    row per key and merged with the buckets it touches only, each into a new version; the highest version of a bucket is
    current, and a replayed batch writes its version again.  Give target and checkpoint again to go on later."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        newest = keep_latest(batch, keys, recency).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        newest.persist()
        old = _current(spark, target, batch_id)
        touched = [r["bucket"] for r in newest.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        parts = [p for b, p in old.items() if b in touched]
        if parts:
            before = spark.read.schema(stream.schema).parquet(*parts).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            merged = keep_latest(before.unionByName(newest), [*keys, "bucket"], recency)
        else:
            merged = newest
        if touched:
            merged.withColumn("version", F.lit(batch_id)).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(target)
        newest.unpersist()

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint or fresh_path(spark, "upsert-ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    now = list(_current(spark, target).values())
    return spark.read.schema(stream.schema).parquet(*now) if now else spark.createDataFrame([], stream.schema)
