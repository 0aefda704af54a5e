"""Threshold-cross alerts over a stream, in event-time order across micro-batches, with timers and expiring state.

Keys are dealt into hash buckets, and a bucket's keys share one state: what a call of the state store and of Python costs is paid
once a bucket and its keys are judged side by side.  Rows wait in the state until the watermark has passed them; an event-time
timer then takes them in order, so a row that comes late, but within the delay, is judged where it belongs whatever micro-batch
brings it.  A second timer drops what is known of a key when no row has come for ``expire_hours`` of event time; it fires as the
watermark moves, also while a backlog is drained.  State needs the RocksDB provider, which this module sets on the session.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "key bigint, ts timestamp, value double"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


_ID = ["nokey", "key"]
_ROW, _SIDE = [*_ID, "at", "value"], [*_ID, "above", "kept", "newest"]
_NEVER = -(1 << 62)  # of a key without a kept alert


class CrossingAlerts(StatefulProcessor):
    """State of a bucket: rows not yet passed by the watermark; of each key the last side, last kept alert and newest row (microseconds)."""

    def __init__(self, level: float, gap_us: int, expire_us: int | None):
        self.level, self.gap, self.expire = level, gap_us, expire_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "nokey boolean, key bigint, at bigint, value double")
        self.sides = handle.getListState("sides", "nokey boolean, key bigint, above boolean, kept bigint, newest bigint")

    @staticmethod
    def _read(state, columns: list[str]) -> pd.DataFrame:
        rows = [tuple(r) for r in state.get()] if state.exists() else []
        kinds = {"nokey": bool, "key": "int64", "at": "int64", "value": "float64", "above": bool, "kept": "int64", "newest": "int64"}
        return pd.DataFrame(rows, columns=columns).astype({c: kinds[c] for c in columns})

    @staticmethod
    def _write(state, rows: pd.DataFrame) -> None:
        if len(rows):
            state.put(list(zip(*(rows[c].tolist() for c in rows.columns))))
        else:
            state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for f in rows:
            got = f[_ROW].dropna(subset=["at"]).astype({"at": "int64", "value": "float64"})
            if len(got):
                self.waiting.appendList(list(zip(*(got[c].tolist() for c in _ROW))))
                low = int(got["at"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting, sides = self._read(self.waiting, _ROW), self._read(self.sides, _SIDE)
        is_due = waiting["at"] // 1000 <= passed
        due, left = waiting[is_due], waiting[~is_due]
        if len(due):
            alerts, sides = self._judge(due, sides)
            self._write(self.waiting, left)
            if len(left):
                self.handle.registerTimer(int(left["at"].min()) // 1000)
        if self.expire:
            # a key with rows that wait is kept
            idle = ~pd.MultiIndex.from_frame(sides[_ID]).isin(pd.MultiIndex.from_frame(left[_ID]))
            gone = idle & (sides["newest"] + self.expire <= passed * 1000).to_numpy()
            later = sides.loc[idle & ~gone, "newest"]
            if len(later):
                self.handle.registerTimer((int(later.min()) + self.expire) // 1000 + 1)
            changed, sides = bool(gone.any()), sides[~gone]
        if len(due) or (self.expire and changed):
            self._write(self.sides, sides)
        if len(due) and len(alerts):
            yield pd.DataFrame({"key": pd.array(alerts["key"].where(~alerts["nokey"]), dtype="Int64"), "ts": pd.to_datetime(alerts["at"].to_numpy(), unit="us"), "value": alerts["value"].to_numpy()})

    def _judge(self, due: pd.DataFrame, sides: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The alerts among the rows, each key's in order of time, and the sides after them."""
        due = due.sort_values([*_ID, "at", "value"], na_position="last", ignore_index=True).merge(sides, on=_ID, how="left")
        new = ~due.duplicated(_ID).to_numpy()
        now = (due["value"] > self.level).to_numpy()
        before = np.where(new, due["above"].eq(True).to_numpy(), np.r_[False, now[:-1]])
        kept = due["kept"].fillna(_NEVER).astype("int64").to_numpy().copy() if due["kept"].isna().any() else due["kept"].to_numpy().copy()
        at, keep = due["at"].to_numpy(), now & ~before
        if self.gap:
            who, last = np.cumsum(new), {}
            for i in np.flatnonzero(keep):  # crossings only
                keep[i] = at[i] >= last.get(who[i], int(kept[i])) + self.gap
                if keep[i]:
                    last[who[i]] = int(at[i])
        alerts = due.loc[keep, _ROW]
        ends = due.assign(above=now, kept=np.where(keep, at, kept), newest=due["at"]).groupby(_ID, sort=False).agg({"above": "last", "kept": "max", "newest": "last"}).reset_index()
        return alerts, pd.concat([sides, ends[_SIDE]], ignore_index=True).drop_duplicates(_ID, keep="last", ignore_index=True) if len(sides) else ends[_SIDE]


def crossing_alerts(stream: DataFrame, level: float, min_gap_hours: float = 0.0, delay: str = "1 hour", expire_hours: float | None = None, buckets: int = 1024) -> DataFrame:
    """(key, ts, value) in, alerts out: a key's value crosses the level upwards, re-arms after falling back, and alerts keep a minimum gap.

    Rows up to the watermark (newest time less ``delay``) are judged; later ones wait in the state, also after a drain, for
    the next run from the same checkpoint.  Rows behind the watermark are dropped, as are null times; equal times are taken by
    value, NaN last; NaN and null are not above the level.  The state holds the rows of one delay and, of every key, its side.  ``buckets`` is the number of states the
    keys are dealt to; it belongs to the checkpoint.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    timed = stream.select("key", F.col("ts").cast("timestamp").alias("ts"), "value").withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), F.col("key").isNull().alias("nokey"), F.coalesce("key", F.lit(0)).cast("bigint").alias("key"), "ts", F.unix_micros("ts").alias("at"), F.col("value").cast("double").alias("value"))
    step = CrossingAlerts(level, int(min_gap_hours * 3.6e9), None if expire_hours is None else int(expire_hours * 3.6e9))
    return timed.groupBy("bucket").transformWithStateInPandas(step, SCHEMA, "Append", "EventTime")
