"""The feature matrix deals its rows once, and only the columns that are read; z-scores deal none by day."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tidemark.operators import factors as FA, features as FE

D0 = dt.date(2021, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _inputs(spark):
    rnd = random.Random(2)
    day = lambda i: D0 + dt.timedelta(i)
    bars = spark.createDataFrame([(s, day(i), 20 + rnd.randrange(900) / 100, float(rnd.randrange(1, 50))) for s in (1, 2, 3) for i in sorted(rnd.sample(range(400), 90))], "symbol long, date date, close double, volume double")
    facts = spark.createDataFrame([(rnd.randrange(1, 5), "eps", "10-K", k, day(rnd.randrange(-20, 400)), day(rnd.randrange(-90, 300)), float(k)) for k in range(60)],
                                  "symbol long, metric string, form string, accn long, filed date, period_end date, value double")
    news = spark.createDataFrame([(rnd.randrange(1, 5), day(rnd.randrange(400)), float(rnd.randrange(9))) for _ in range(120)], "symbol long, date date, score double")
    return bars, facts, news


def test_feature_matrix_equals_a_plain_loop_and_shuffles_bars_once(spark):
    bars, facts, news = _inputs(spark)
    fm = FA.feature_matrix(bars, facts, ["eps"], news=news)
    by, fs, ns = {}, facts.collect(), news.collect()
    for r in bars.collect():
        by.setdefault(r.symbol, []).append(r)
    got = {(r.symbol, r.date): r for r in fm.collect()}
    assert len(got) == 270
    for s, rows in by.items():
        rows.sort(key=lambda r: r.date)
        for i, r in enumerate(rows):
            g = got[s, r.date]
            assert (g.close, g.volume) == (r.close, r.volume)
            assert g.ret_21d == (rows[i].close / rows[i - 21].close - 1 if i >= 21 else None)
            filed = max((f.filed for f in fs if f.symbol == s and f.filed <= r.date), default=None)
            assert g.fund_eps == max(((f.period_end, f.accn, f.value) for f in fs if f.symbol == s and f.filed == filed), default=(0, 0, None))[2]
            near = [n.score for n in ns if n.symbol == s and 0 <= (r.date - n.date).days < 21]
            assert g.news_count_21d == len(near) and g.news_score_21d == (sum(near) / len(near) if near else None)
    # one exchange for bars, sides and price features together, one for each aggregated side
    assert len(re.findall(r"Exchange hashpartitioning", _plan(fm).split("== Initial Plan")[0])) == 3
    # what is not read is not dealt
    assert "volume" not in _plan(fm.select("symbol", "date", "ret_63d")).split("Exchange", 1)[1].split("\n", 1)[0] and "stddev" not in _plan(fm.select("symbol", "ret_63d"))


def test_zscores_deal_no_row_by_day_and_a_factor_without_weight_is_not_read(spark):
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, -1)  # at size the planner cannot see that a side is small
    try:
        raw = spark.range(60).select("id", F.lit(D0).alias("date"), F.col("id").cast("double").alias("x"))
        assert "SortMergeJoin" not in _plan(FE.zscore_by(raw, "date", ["x"]))
    finally:
        spark.conf.set(key, before)
    raw = spark.createDataFrame([("A", D0, 1.0, float("nan")), ("B", D0, 3.0, 1.0)], "symbol string, date date, momentum double, value double")
    got = {r.symbol: r.composite for r in FA.signal_panel(raw, {"momentum": 1.0, "value": 0.0}).collect()}
    assert got == {"A": -1.0, "B": 1.0}
