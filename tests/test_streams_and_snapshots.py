"""Alerts with timers and expiring state, snapshot commits, file metadata checks, long de-clustering."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as FE, quality as V
from tidemark.sources import sinks, snapshots
from tidemark.streaming import alerts as AL, feeds as SF

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key bigint, ts timestamp_ntz, value double"


def add(spark, folder, rows):
    spark.createDataFrame([(k, None if h is None else T0 + dt.timedelta(hours=h), v) for k, h, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, tmp_path, name="out", **kw):
    src = SF.file_stream(spark, str(tmp_path / "in"), "*.parquet", SCHEMA, 1)
    return SF.drain(AL.crossing_alerts(src, 100.0, **kw), target=str(tmp_path / name), checkpoint=str(tmp_path / f"{name}-ck"))


def at(df):
    return sorted(((r.key, (r.ts - T0).total_seconds() / 3600, r.value) for r in df.collect()), key=lambda x: (x[0] is not None, x))


def test_late_rows_are_judged_in_order_across_three_files_and_restarts(spark, tmp_path):
    """The second file brings a row that belongs before one of the first: the rise at hour 4 is then a continuation."""
    add(spark, tmp_path / "in", [(1, 1, 50.0), (1, 4, 150.0), (1, 6, 90.0), (2, 0, None), (2, 1, float("nan"))])
    first = at(run(spark, tmp_path, delay="10 hours"))
    assert first == []  # everything is within the delay
    add(spark, tmp_path / "in", [(1, 3, 160.0), (1, 14, 170.0), (None, 2, 500.0), (3, None, 500.0)])
    second = at(run(spark, tmp_path, delay="10 hours"))
    assert second == [(None, 2.0, 500.0), (1, 3.0, 160.0)]  # hour 4 is above already; the watermark is at hour 4; null is a key
    add(spark, tmp_path / "in", [(2, 40, 120.0), (1, 2, 999.0)])  # the second row is behind the watermark
    assert at(run(spark, tmp_path, delay="10 hours")) == [*second, (1, 14.0, 170.0)]


def test_alerts_rearm_and_keep_the_gap(spark, tmp_path):
    add(spark, tmp_path / "in", [(1, 0, 50.0), (1, 1, 150.0), (1, 2, 160.0)])
    add(spark, tmp_path / "in", [(1, 3, 90.0), (1, 4, 170.0), (1, 5, 10.0), (1, 30, 180.0), (9, 60, 0.0)])
    assert [v for _, _, v in at(run(spark, tmp_path, "a"))] == [150.0, 170.0, 180.0]
    assert [v for _, _, v in at(run(spark, tmp_path, "b", min_gap_hours=12))] == [150.0, 180.0]


def test_state_expires_while_a_backlog_is_drained(spark, tmp_path):
    """Key 1 stays above; without rows for a day its state goes, so the next row above is a new crossing."""
    for rows in ([(1, 0, 150.0)], [(2, 10, 1.0)], [(2, 60, 1.0)], [(2, 61, 1.0)], [(1, 62, 160.0)], [(2, 90, 1.0)]):
        add(spark, tmp_path / "in", rows)
    assert [h for k, h, _ in at(run(spark, tmp_path, "kept")) if k == 1] == [0.0]
    assert [h for k, h, _ in at(run(spark, tmp_path, "gone", expire_hours=24)) if k == 1] == [0.0, 62.0]


def test_batch_twin(spark, tmp_path):
    rows = [(k, (k * 7 + i * 13) % 97 + i / 100, float((k * 31 + i * 17) % 200)) for k in range(5) for i in range(40)]
    for i in range(0, len(rows), 50):
        add(spark, tmp_path / "in", rows[i:i + 50])
    got, last = at(run(spark, tmp_path, delay="200 hours")), max(h for _, h, _ in rows)
    assert got == []  # all wait
    add(spark, tmp_path / "in", [(99, last + 201, 0.0)])
    got, want = at(run(spark, tmp_path, delay="200 hours")), []
    for k in range(5):
        above = False
        for _, h, v in sorted(r for r in rows if r[0] == k):
            if v > 100 and not above:
                want.append((k, round(h, 6), v))
            above = v > 100
    assert [(k, round(h, 6), v) for k, h, v in got] == sorted(want)


def test_a_reader_never_fails_while_versions_are_swapped(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_snapshot(spark.range(100), path)
    stop, seen, errors = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                seen.append(snapshots.read(spark, path).count())
            except Exception as e:  # noqa: BLE001 - the test counts them
                errors.append(e)
    t = threading.Thread(target=read)
    t.start()
    for i in range(20):
        sinks.write_snapshot(spark.range(100 + i), path)
    stop.set()
    t.join()
    assert not errors and seen and seen == sorted(seen) and snapshots.read(spark, path).count() == 119


def test_old_versions_go_after_the_grace_period_and_failures_leave_the_old_one(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(4):
        sinks.write_snapshot(spark.range(i + 1), path)
    assert len(snapshots._commits(spark, path)) == 4
    with pytest.raises(Exception):
        sinks.write_snapshot(spark.range(3).select(F.raise_error(F.lit("stop")).alias("x")), path)
    assert snapshots.read(spark, path).count() == 4
    assert len(snapshots.clean(spark, path, 0)) == 3 and snapshots.read(spark, path).count() == 4
    assert not snapshots.exists(spark, str(tmp_path / "absent"))
    sinks.write_snapshot(snapshots.read(spark, path).where("id < 2"), path)  # a version made from the one before
    assert snapshots.read(spark, path).count() == 2


def test_newest_file_and_empty_scans(spark, tmp_path):
    base = str(tmp_path / "raw")
    for i, n in enumerate((5, 3, 7)):
        spark.range(n).coalesce(1).write.parquet(f"{base}/batch={i}")
    df = spark.read.parquet(base)
    assert V.newest_files(df, "file").count() == 7 and V.newest_files(df).count() == 7
    assert sorted(r["rows"] for r in V.files(df).collect()) == [3, 5, 7]
    empty = spark.read.schema("id long").parquet(str(tmp_path / "raw" / "batch=0")).where("id < 0")
    assert V.validate_latest({"t": (empty, V.TableSchema())}, "2024-01-01").head()["status"] == "NO DATA"


def test_declustering_is_linear_in_a_long_key(spark):
    days = spark.range(100_000).select(F.lit("a").alias("symbol"), F.date_from_unix_date((F.col("id") - 50_000).cast("int")).alias("date"))
    got = FE.decluster(days, 2).agg(F.count("*").alias("n"), F.min("date").alias("a")).head()
    assert got["n"] == 50_000
    odd = spark.createDataFrame([(None, dt.date(2024, 1, 1)), (None, dt.date(2024, 1, 2)), ("b", None)], "symbol string, date date")
    assert FE.decluster(odd, 5).collect() == [(None, dt.date(2024, 1, 1))]
