"""Event paths are made for the events' own days, not for every bar."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import studies as ST

D0 = dt.date(2020, 1, 1)


def test_paths_equal_a_plain_loop_and_skip_bars_without_event(spark):
    rnd = random.Random(3)
    days = {s: sorted(rnd.sample(range(60), n)) for s, n in ((1, 50), (2, 30), (3, 4))}
    px = {(s, d): 50 + rnd.randrange(900) / 100 for s, ds in days.items() for d in ds}
    for d in (0, 5, 9):
        px[4, d] = 0.0  # a symbol that no event names: its returns have no base and are not to be asked for
    bars = spark.createDataFrame([(s, D0 + dt.timedelta(d), p) for (s, d), p in px.items()] + [(None, D0, 1.0)], "symbol long, date date, close double")
    known = [(i, rnd.choice([1, 1, 2, 3, 7, None]), rnd.choice([None, *range(62)])) for i in range(150)]
    events = spark.createDataFrame([(i, s, None if d is None else D0 + dt.timedelta(d)) for i, s, d in known], "id long, symbol long, date date")
    want = {}
    for i, s, d in known:
        ds = days.get(s, [])
        at = next((k for k, x in enumerate(ds) if d is not None and x >= d), None)
        if at is None or at + 5 >= len(ds) or at + 1 - 2 < 0 or ds[at + 1] - d > 15:
            continue
        want[i] = (ds[at + 1], [px[s, ds[at + 1 + k]] / px[s, ds[at]] - 1 for k in range(-2, 5)])
    out = ST.event_paths(events, bars, -2, 4, entry_lag=1)
    assert out.columns == ["id", "symbol", "date", "day0", "path"]
    assert {r.id: ((r.day0 - D0).days, r.path) for r in out.collect()} == want and len(want) > 40
    bench = bars.where("symbol = 1").select("date", F.col("close").alias("bench"))
    own = ST.event_paths(events.where("symbol = 1"), bars, -2, 4, bench, entry_lag=1).collect()
    assert own and all(x == 0 for r in own for x in r.path)
