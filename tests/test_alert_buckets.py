"""A bucket's keys are judged side by side, with few calls of the state store, as a plain loop judges them one by one."""

import random

import pandas as pd

from tidemark.streaming import alerts as AL


class State:
    calls = 0

    def __init__(self):
        self.rows = []

    def exists(self):
        State.calls += 1
        return bool(self.rows)

    def get(self):
        State.calls += 1
        return iter(self.rows)

    def put(self, rows):
        State.calls += 1
        self.rows = list(rows)

    def appendList(self, rows):
        State.calls += 1
        self.rows += rows

    def clear(self):
        State.calls += 1
        self.rows = []


class Handle:
    def __init__(self):
        self.timers = set()

    def getListState(self, name, schema):
        return State()

    def registerTimer(self, ms):
        State.calls += 1
        self.timers.add(ms)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _plain(rows, gap):
    out, side = [], {}
    for nokey, key, at, value in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3] != r[3], r[3])):
        above, kept = side.get((nokey, key), (False, None))
        if value > 100 and not above and (kept is None or at >= kept + gap):
            out.append((None if nokey else key, at, value))
            kept = at
        side[nokey, key] = (value > 100, kept)
    return sorted(out, key=str)


def test_batches_of_many_keys_equal_a_plain_loop():
    for gap in (0, 5_000):
        rnd = random.Random(gap)
        step, handle, State.calls = AL.CrossingAlerts(100.0, gap, None), Handle(), 0
        step.init(handle)
        rows, got = [], []
        for batch in range(4):
            new = [(k == 0, k, batch * 20_000 + rnd.randrange(30) * 1000, rnd.choice([50.0, 150.0, 160.0, float("nan")])) for k in range(300) for _ in range(rnd.randrange(4))]
            rows += new
            list(step.handleInputRows((7,), iter([pd.DataFrame(new, columns=["nokey", "key", "at", "value"])]), None))
            passed = Watermark(batch * 20 - 1 if batch < 3 else 1000)
            for due in sorted(t for t in handle.timers if t <= passed.ms):
                handle.timers.discard(due)
                for f in step.handleExpiredTimer((7,), passed, None):
                    got += [(None if pd.isna(k) else int(k), int(t.value // 1000), v) for k, t, v in zip(f["key"], f["ts"], f["value"])]
        assert sorted(got, key=str) == _plain(rows, gap) and len(got) > 200
        assert State.calls < 200  # 300 keys in four batches
