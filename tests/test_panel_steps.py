"""Panels and pooled ranks at size: one window pass per symbol, no rows dealt by a hot group, a day's rank IC worked out once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as FE, relational as RL, research_stats as RS


@pytest.fixture
def no_guess(spark):
    """At size the planner cannot see that a side is small."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, -1)
    yield
    spark.conf.set(key, before)


def _bars(spark):
    rnd = random.Random(5)
    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=i), 50 + rnd.randrange(900) / 100) for s, n in ((1, 40), (2, 11), (3, 12), (4, 60), (5, 25)) for i in sorted(rnd.sample(range(90), n))]
    return spark.createDataFrame(rows, "symbol long, date date, close double")


def _bench(b):
    return b.where("symbol < 5").groupBy("date").agg(F.avg("close").alias("bench"))


def test_own_bars_give_the_panel_of_the_as_of_join(spark, no_guess):
    b = _bars(spark).localCheckpoint()
    valued = FE.returns(b, (5,)).withColumn("value", F.when(F.col("symbol") + F.dayofmonth("date") != 9, F.round("ret_5d", 9)))
    want = FE.return_panel(valued.where("value is not null").select("symbol", "date", "value"), b, _bench(b), [1, 5, 10], daily=True).where("entry_date is not null")
    got = FE.own_bar_panel(valued, "value", _bench(b), [1, 5, 10])
    cols = ["symbol", "date", "value", "entry_date", "fwd_1d", "fwd_5d", "fwd_10d"]
    assert got.count() > 90 and sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.select(cols).collect()))
    # rows meet the benchmark where they are: no shuffle by date alone
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [date" in plan and "SortMergeJoin" not in plan


def test_rows_are_not_dealt_by_a_large_group(spark, no_guess):
    rows = spark.range(2000).selectExpr("id % 2 as g", "id % 37 * 1.0D as x", "hash(id) * 1.0D as y")
    plan = RL.average_ranks(rows, ["g"], {"x": "rx", "y": "ry"})._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "SortMergeJoin [g" in line and "], [g" in line and line.split("SortMergeJoin ")[1].split("]")[0].count("#") == 1]


def test_hot_values_in_large_groups(spark, monkeypatch):
    """Half of the rows share a value, buckets below and above the limit, a null group."""
    rows = [(g, 1.0 if i % 2 else float(i % 7) - 3, (i * 37 % 101) / 10.0) for g in (1, 2, None) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, x double, y double")
    monkeypatch.setattr(RL, "SORTED_ROWS", 30)
    got = {(r.g, r.x, r.y): (r.rx, r.ry) for r in RL.average_ranks(df, ["g"], {"x": "rx", "y": "ry"}).collect()}
    assert {g for g, _, _ in got} == {1, 2}
    xs, ys = sorted(r[1] for r in rows if r[0] == 1), sorted(r[2] for r in rows if r[0] == 1)
    mean = lambda s, v: s.index(v) + (s.count(v) + 1) / 2
    assert all((rx, ry) == (mean(xs, x), mean(ys, y)) for (_, x, y), (rx, ry) in got.items())


def test_a_day_of_several_keys_is_ranked_once(spark):
    rnd = random.Random(7)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), rnd.random(), rnd.random()) for i in range(12) for _ in range(3 + i % 6)]
    p = spark.createDataFrame(rows, "date date, value double, fwd double").localCheckpoint()
    days = p.select("date").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.dayofmonth("date") % 2 + 1)))
    want = RS.daily_ic(p.join(days, "date"), "value", "fwd", ["k"]).collect()
    got = RS.daily_ic_on(p, "value", "fwd", days, ["k"]).collect()
    show = lambda rs: sorted((r.k, r.ic_days, r.mean_daily_ic and round(r.mean_daily_ic, 12), r.daily_reason) for r in rs)
    assert show(got) == show(want)


def test_repeated_dates_are_matched_without_time_buckets(spark):
    from tidemark.operators.asof import asof_join
    b = _bars(spark).localCheckpoint()
    left = b.select("symbol", F.date_sub("date", 3).alias("day")).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3))))
    right = b.select("symbol", F.col("date").alias("entry"), "close")
    got = asof_join(left, right, ["symbol"], "day", "entry", ["entry", "close"], forward=True, strict=True, repeated=True)
    assert "date_trunc" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    bars = sorted((r.symbol, r.date, r.close) for r in b.collect())
    first = lambda s, day: next(((d, c) for k, d, c in bars if k == s and d > day), (None, None))
    rows = got.collect()
    assert len(rows) == left.count() and all((r.entry, r.close) == first(r.symbol, r.day) for r in rows)


def test_option_grid_keeps_bars_where_they_are(spark, no_guess):
    from tidemark.operators import options as OP
    base = spark.range(50).selectExpr("id as symbol", "date_add(date'2020-01-01', cast(id % 5 as int)) as date", "50.0D as spot", "0.01D as q", "0.2D as s")
    rates = base.select("date").distinct().withColumn("rates", F.array(F.lit(0.03)))
    plan = OP.option_grid(base, rates, [1.0], [30], {"cc": "s"})._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [date" in plan and "SortMergeJoin" not in plan
