"""Planted answers, brute-force comparisons and invariants on small frames."""

import datetime as dt
import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import distributions as DI, exprs as X, pricing as PR
from tidemark.operators import (asof as AS, dedup as D, features as FE, factors as FA, options as OP, portfolio as PF, quality as V, registry as RG, relational as U, reports as RP,
                                research_stats as RS, studies as ST, technical as TE, text as TX)

DAY = dt.date(2020, 1, 1)


def day(i):
    return DAY + dt.timedelta(days=i)


def bars_frame(spark, n=120, symbols=("A", "B"), seed=7):
    rng, rows = np.random.default_rng(seed), []
    for s in symbols:
        c = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        for i in range(n):
            o = c[i] * (1 + rng.normal(0, 0.003))
            rows.append((s, day(i), float(o), float(max(o, c[i]) * 1.004), float(min(o, c[i]) * 0.996), float(c[i]), float(rng.integers(100, 1000))))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


# --- relational core -------------------------------------------------------------------------

@pytest.mark.parametrize("forward,strict", [(False, False), (False, True), (True, False), (True, True)])
@pytest.mark.parametrize("split", [None, "week", "quarter"])
def test_asof_join_equals_brute_force_with_a_hot_key(spark, forward, strict, split):
    rnd = random.Random(3)
    left = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(4)}", day(rnd.randrange(400)), i) for i in range(300)]
    right = sorted({("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(4)}", day(rnd.randrange(400))) for _ in range(80)})
    L = spark.createDataFrame(left, "k string, t date, id int")
    R = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(right)], "k string, rt date, v int")
    got = {r.id: r.v for r in AS.asof_join(L, R, ["k"], "t", "rt", ["v"], forward=forward, strict=strict, split=split).collect()}

    def want(k, t):
        ok = (lambda x: x > t if strict else x >= t) if forward else (lambda x: x < t if strict else x <= t)
        c = [(rt, i) for i, (rk, rt) in enumerate(right) if rk == k and ok(rt)]
        return (min(c) if forward else max(c))[1] if c else None
    assert got == {i: want(k, t) for k, t, i in left}


def test_trailing_range_counts_zero_and_sums_null_without_events(spark):
    p = spark.createDataFrame([("A", day(10)), ("A", day(40)), ("B", day(10))], "symbol string, date date")
    e = spark.createDataFrame([("A", day(8), 5.0), ("A", day(10), 7.0), ("A", day(1), 100.0)], "symbol string, d date, x double")
    rows = {(r.symbol, r.date): r for r in AS.trailing_range_agg(p, e, "symbol", "date", "d", {"s": F.col("x")}, 9, {"n": F.col("x")}, {"m": F.col("x")}).collect()}
    assert (rows["A", day(10)].s, rows["A", day(10)].n, rows["A", day(10)].m) == (12.0, 2, 6.0)
    assert (rows["A", day(40)].s, rows["A", day(40)].n, rows["A", day(40)].m) == (None, 0, None) and rows["B", day(10)].n == 0


def test_positions_and_ranks_equal_brute_force(spark):
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.7 else "x", i, rnd.choice([0.0, -1.5, 2.25, rnd.uniform(-1e6, 1e6), rnd.uniform(-1e-3, 1e-3)])) for i in range(400)]
    df = spark.createDataFrame(data, "g string, id int, v double")
    pdf = pd.DataFrame(data, columns=["g", "id", "v"])
    rank = {r.id: r.r for r in U.average_rank(df, ["g"], "v", "r").collect()}
    assert rank == dict(zip(pdf.id, pdf.groupby("g").v.rank(method="average")))
    assert {r.id: r.r for r in U.calendar_ranks(df, ["g"], {"v": "r"}).collect()} == rank
    for desc in (False, True):
        pos = {r.id: (r.p, r.p_of) for r in U.position_within(df, ["g"], "v", "id", "p", descending=desc).collect()}
        want = pdf.assign(s=-pdf.v if desc else pdf.v).sort_values(["g", "s", "id"])
        want["p"] = want.groupby("g").cumcount() + 1
        want["n"] = want.groupby("g").id.transform("size")
        assert pos == {r.id: (r.p, r.n) for r in want.itertuples()}


def test_dedup_newest_wins_null_is_oldest_partial_key_never_used(spark):
    df = spark.createDataFrame([("A", "2020-01-01", 1.0, "2020-02-01"), ("A", "2020-01-01", 2.0, "2020-03-01"), ("A", "2020-01-01", 9.0, None), ("A", "2020-01-02", 3.0, "2020-01-05")],
                               "symbol string, date string, close double, fetched_at string")
    got = {r.date: r.close for r in D.dedup(df, ["symbol", "date"]).collect()}
    assert got == {"2020-01-01": 2.0, "2020-01-02": 3.0}
    assert D.dedup_key(df.columns, ["symbol", "date", "gone"]) == ["symbol", "date", "close"]
    assert D.dedup(df, ["symbol", "gone"]).count() == 4


def test_top_per_group_is_exact_for_a_hot_group(spark):
    data = [("hot", i, float((i * 37) % 991)) for i in range(900)] + [("x", i, float(i)) for i in range(5)]
    got = RP.top_per_group(spark.createDataFrame(data, "g string, id int, v double"), "g", ["v", "id"], 3).collect()
    assert sorted((r.g, r.v) for r in got) == sorted([("hot", v) for v in sorted((x[2] for x in data if x[0] == "hot"))[-3:]] + [("x", 2.0), ("x", 3.0), ("x", 4.0)])


# --- scalars ---------------------------------------------------------------------------------

def test_business_day_shift_matches_numpy(spark):
    rows = [(day(i),) for i in range(30)]
    got = spark.createDataFrame(rows, "d date").select("d", *[X.business_day_shift("d", n).alias(f"s{n}") for n in (0, 1, 4, 5, 11)]).collect()
    for r in got:
        assert r.s0 == r.d
        for n in (1, 4, 5, 11):
            start = r.d - dt.timedelta(days=max(0, r.d.weekday() - 4))
            assert r[f"s{n}"] == np.busday_offset(start, n).astype(dt.date)


def test_period_strings_and_dirty_numbers(spark):
    cases = {"2024Q1": "2024-01-01", "2024-Q4": "2024-10-01", "202403": "2024-03-01", "2024": "2024-01-01", "2024-07": "2024-07-01", "1960M01": "1960-01-01", "2024-Q02": "2024-04-01", "2024-M13": None, "junk": None}
    df = spark.createDataFrame(list(cases.items()), "s string, want string")
    assert all(r.got == r.want for r in df.select("want", X.period_to_date("s").cast("string").alias("got")).collect())
    nums = spark.createDataFrame([("$1,234.5", 1234.5), ("12%", 12.0), ("(D)", None)], "s string, want double")
    assert all(r.got == r.want for r in nums.select("want", X.to_number("s").alias("got")).collect())


def test_label_edges_differ_between_vendor_and_computed(spark):
    got = spark.createDataFrame([(0.5,), (0.1,), (-0.1,), (-0.5,), (None,)], "x double").select(X.vendor_rating_label("x").alias("a"), X.rating_bin("x").alias("b")).collect()
    assert [r.a for r in got] == ["strong_buy", "buy", "sell", "strong_sell", "unknown"]
    assert [r.b for r in got] == ["buy", "neutral", "sell", "strong_sell", None]


def test_t_tails_against_numeric_integration_and_published_values(spark):
    def tail(t, v):  # independent: Simpson's rule on the cosine form of the density
        hi, n = math.atan(400.0 + t) if v > 2 else math.pi / 2, 4000
        lo = math.atan(t / math.sqrt(v))
        hi = min(math.pi / 2, math.atan((t + 60) / math.sqrt(v))) if v > 20 else math.pi / 2
        h = (hi - lo) / n
        f = [math.cos(lo + k * h) ** (v - 1) * (1 if k in (0, n) else 4 if k % 2 else 2) for k in range(n + 1)]
        return 2 * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi) * sum(f) * h / 3
    cases = [(t, v) for v in (3.0, 4.5, 10.0, 30.0, 99.7, 300.0) for t in (0.01, 0.5, 1.0, 1.96, 2.5, 6.0)]
    rows = spark.createDataFrame([(t, v) for t, v in cases] + [(-t, v) for t, v in cases], "t double, df double").select("t", "df", DI.t_two_sided("t", "df").alias("p")).collect()
    assert all(r.p == pytest.approx(tail(abs(r.t), r.df), abs=1e-8) for r in rows)
    odd = spark.createDataFrame([(2.228, 10.0, 0.05), (12.706, 1.0, 0.05), (2.576, 1e7, 0.01), (0.0, 5.0, 1.0), (1.812, 10.0, 0.1), (float("nan"), 5.0, None), (float("inf"), 5.0, None), (None, 5.0, None), (1.0, 0.0, None)], "t double, df double, want double")
    assert all(r.p is None if r.want is None else r.p == pytest.approx(r.want, abs=2e-4) for r in odd.select("want", DI.t_two_sided("t", "df").alias("p")).collect())


def test_normal_quantile_and_distribution(spark):
    ps = [1e-12, 1e-6, 0.001, 0.02425, 0.1, 0.5, 0.9, 0.97575, 0.999, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double").select(DI.normal_quantile("p").alias("x")).collect()
    assert all(g.x == pytest.approx(NormalDist().inv_cdf(p), abs=1e-8) for g, p in zip(got, ps)) and [g.x for g in got[-3:]] == [None] * 3
    xs = np.linspace(-9, 9, 181).tolist()
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(PR.normal_cdf(F.col("x")).alias("p"), DI.normal_probability("x").alias("q")).collect()
    assert all(g.p == g.q for g in got)
    assert np.allclose([g.p for g in got], [NormalDist().cdf(x) for x in xs], atol=1e-14)


def test_deflated_sharpe_falls_with_the_dispersion_of_trials_and_names_reasons(spark):
    series = spark.createDataFrame([("a", 0.0009 + 0.01 * math.sin(i)) for i in range(500)] + [("b", 0.1)] * 10 + [("c", None)] + [("d", 0.01 * (i % 3)) for i in range(12)], "strategy string, ret double")
    trials = lambda v: spark.createDataFrame([(x,) for x in v], "value double")
    run = lambda v: {r.strategy: r for r in RS.deflated_sharpe(series, trials(v)).collect()}
    tight, wide = run([0.2, 0.3, 0.1, -0.1, None, float("nan")]), run([3.0, -3.0, 2.5, -2.5])
    assert tight["a"].n_trials == 4 and tight["a"].dsr_prob > 0.9 > wide["a"].dsr_prob and wide["a"].sr0_ann > tight["a"].sr0_ann
    assert tight["b"].dsr_reason == "no observed Sharpe" and tight["d"].dsr_reason == "only 12 days (< 30)" and "c" not in tight
    small, flat = run([1.0]), run([1.0, 1.0])
    assert small["a"].dsr_prob is None and "population too small" in small["a"].dsr_reason and "zero variance" in flat["a"].dsr_reason


# --- features --------------------------------------------------------------------------------

def test_returns_momentum_and_no_look_ahead(spark):
    rows = [("A", day(i), 100 * 1.0005 ** i, 1000.0) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, date date, close double, volume double")
    last = FE.price_features(df).orderBy(F.desc("date")).first()
    assert last.ret_1d == pytest.approx(0.0005) and last.mom_12_1 == pytest.approx(1.0005 ** 231 - 1) and last.vol_21d >= 0
    changed = df.withColumn("close", F.when(F.col("date") > F.lit(day(200)), F.col("close") * 3).otherwise(F.col("close")))
    a, b = (FE.price_features(x).where(F.col("date") <= F.lit(day(200))).orderBy("date").collect() for x in (df, changed))
    assert a == b


def test_zscore_constant_is_zero_and_all_null_stays_null(spark):
    df = spark.createDataFrame([(day(0), "A", 1.0, 5.0, None), (day(0), "B", 2.0, 5.0, None), (day(0), "C", 3.0, 5.0, None)], "date date, symbol string, x double, y double, n double")
    z = {r.symbol: r for r in FE.zscore_by(df, "date", ["x", "y", "n"]).collect()}
    assert [z[s].x for s in "ABC"] == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)]) and all(z[s].y == 0 and z[s].n is None for s in "ABC")


def test_composite_renormalises_over_present_factors(spark):
    raw = spark.createDataFrame([("A", day(0), 1.0, None), ("B", day(0), 2.0, 1.0), ("C", day(0), 3.0, 3.0)], "symbol string, date date, momentum double, growth double")
    got = {r.symbol: r.composite for r in FA.signal_panel(raw, {"momentum": 1.0, "growth": 1.0}).collect()}
    assert got["A"] == pytest.approx(-math.sqrt(1.5)) and got["B"] == pytest.approx((0 - 1) / 2)


def test_feature_matrix_never_drops_rows_and_joins_on_filing_date(spark):
    b = bars_frame(spark, 60)
    facts = spark.createDataFrame([("A", "eps", "10-K", 1, day(20), day(5), 1.5), ("A", "eps", "10-K", 1, day(20), day(15), 2.5)], "symbol string, metric string, form string, accn int, filed date, period_end date, value double")
    fm = FA.feature_matrix(b, facts, ["eps"])
    got = {r.date: r.fund_eps for r in fm.where("symbol = 'A'").collect()}
    assert fm.count() == 120 and got[day(19)] is None and got[day(20)] == 2.5 and got[day(59)] == 2.5


def test_decluster_keeps_first_then_gap(spark):
    ev = spark.createDataFrame([("A", day(i)) for i in (0, 3, 9, 10, 12, 25)] + [("A", day(0))], "symbol string, date date")
    assert sorted(r.date for r in FE.decluster(ev, 10).collect()) == [day(0), day(10), day(25)]


def test_drawdown_episode_open_at_the_end(spark):
    df = spark.createDataFrame([("A", day(i), c) for i, c in enumerate([10.0, 12.0, 9.0, 12.0, 13.0, 11.0, 12.0])], "symbol string, date date, close double")
    ep = sorted(FE.drawdown_episodes(FE.drawdowns(df)).collect(), key=lambda r: r.peak_date)
    assert [(e.peak_date, e.valley_date, e.recovery_date, e.recovered) for e in ep] == [(day(1), day(2), day(3), True), (day(4), day(5), None, False)]
    assert ep[0].depth_pct == pytest.approx(-25)


# --- technical -------------------------------------------------------------------------------

def test_smoothing_equals_pandas(spark):
    b = bars_frame(spark, 80)
    got = TE.smooth(b, [TE.ema("e", "close", 10), TE.rma("r", "close", 14)]).toPandas().sort_values(["symbol", "date"])
    for s, g in got.groupby("symbol"):
        assert np.allclose(g.e.dropna(), g.close.ewm(span=10, adjust=False, min_periods=10).mean().dropna())
        assert g.e.isna().sum() == 9 and g.r.isna().sum() == 13


def test_ratings_stay_in_range(spark):
    r = TE.ratings(TE.indicators(bars_frame(spark, 260, ("A",)))).agg(F.min("rsi14"), F.max("rsi14"), F.min("rating_all"), F.max("rating_all")).first()
    assert 0 <= r[0] <= r[1] <= 100 and -1 <= r[2] <= r[3] <= 1


# --- pricing ---------------------------------------------------------------------------------

def test_european_price_and_parity(spark):
    df = spark.createDataFrame([(100.0, 100.0, 1.0, 0.05, 0.0, 0.2, "CALL"), (100.0, 100.0, 1.0, 0.05, 0.0, 0.2, "PUT"), (100.0, 90.0, 0.0, 0.05, 0.0, 0.2, "CALL")], "spot double, strike double, t_years double, r double, q double, sigma double, contract_type string")
    c, p, e = PR.european(df).collect()
    assert c.theo_price == pytest.approx(10.450584, abs=1e-5) and p.theo_price == pytest.approx(5.573526, abs=1e-5)
    assert (e.theo_price, e.delta, e.vega) == (10.0, 1.0, 0.0)
    both = {r.contract_type: r for r in PR.european_both(df.drop("contract_type").where("t_years > 0").distinct()).collect()}
    assert both["CALL"].theo_price == c.theo_price and both["PUT"].asDict() == p.asDict()


def test_curve_is_linear_inside_and_clamped_outside(spark):
    pts = F.array(*[F.struct(F.lit(t).alias("tenor"), F.lit(p).alias("pct")) for t, p in ((1.0, 3.0), (2.0, 4.0))])
    got = spark.createDataFrame([(0.1,), (1.5,), (9.0,)], "t double").select(OP.curve_rate(pts, F.col("t")).alias("r")).collect()
    assert [r.r for r in got] == pytest.approx([math.log1p(.03), math.log1p(.035), math.log1p(.04)])


# --- portfolio, studies ----------------------------------------------------------------------

def test_weights_sum_to_one_per_side_and_lag(spark):
    s = spark.createDataFrame([(day(i), f"S{j}", float(j)) for i in range(3) for j in range(10)], "date date, symbol string, score double")
    t = PF.target_weights(s, spark.createDataFrame([(day(1),)], "rebal date"), 5).collect()
    assert {r.symbol: r.weight for r in t} == {"S9": 0.5, "S8": 0.5, "S0": -0.5, "S1": -0.5}
    held = PF.holdings_by_day(s.select("date").distinct(), spark.createDataFrame(t)).select("date").distinct().collect()
    assert [r.date for r in held] == [day(2)]  # nothing is held on the rebalance day itself


def test_event_path_and_lag(spark):
    px = [100.0 + i for i in range(30)]
    b = spark.createDataFrame([("T", day(i), p) for i, p in enumerate(px)], "symbol string, date date, close double")
    ev = spark.createDataFrame([("T", day(10)), ("T", day(28))], "symbol string, date date")
    p0 = ST.event_paths(ev, b, 0, 5).collect()
    assert len(p0) == 1 and p0[0].path[5] == pytest.approx(px[15] / px[9] - 1)
    p1 = ST.event_paths(ev, b, 0, 5, entry_lag=1).collect()[0]
    assert p1.day0 == day(11) and p1.path[0] == pytest.approx(px[11] / px[10] - 1)
    bench = b.select("date", F.col("close").alias("bench"))
    assert max(abs(x) for x in ST.event_paths(ev, b, 0, 5, bench).collect()[0].path) < 1e-12


def _flags(spark, closes, entries, exits):
    return spark.createDataFrame([("A", day(i), float(c), i in entries, i in exits) for i, c in enumerate(closes)], "key string, date date, close double, entry boolean, exit boolean")


def test_pairing_next_bar_no_overlap_and_open_position_blocks(spark):
    t = ST.pair_trades(_flags(spark, range(10, 30), {0, 1, 6, 12}, {4, 9})).orderBy("entry_date").collect()
    assert [(r.entry_date, r.exit_date, r.days_held) for r in t] == [(day(1), day(5), 4), (day(7), day(10), 3)]
    assert t[0].pnl_pct == pytest.approx(100 * (15 / 11 - 1))
    assert ST.pair_trades(_flags(spark, range(10, 20), {0, 5}, {9})).count() == 0  # exit would execute after the last bar


def test_exposure_recovers_planted_beta(spark):
    rng = np.random.default_rng(1)
    x, m = rng.normal(0, .01, 500), rng.normal(0, .01, 500)
    y = 0.5 * x + 0.8 * m + rng.normal(0, .001, 500)
    d = [day(i) for i in range(500)]
    mk = lambda v, c: spark.createDataFrame(list(zip(d, map(float, v))), f"date date, {c} double")
    r = ST.exposure_map(mk(y, "y").withColumn("symbol", F.lit("S")), mk(x, "x").withColumn("driver", F.lit("oil")), mk(m, "m")).first()
    assert r.beta_ex_mkt == pytest.approx(0.5, abs=0.05) and r.t_ex_mkt > 10 and r.n_obs == 500


# --- statistics ------------------------------------------------------------------------------

def _panel(spark, planted, seed=2):
    rng, rows = np.random.default_rng(seed), []
    for i in range(60):
        for j in range(12):
            v = rng.normal()
            rows.append((f"S{j}", day(i), float(v), float((0.3 * v if planted else 0) + rng.normal())))
    return spark.createDataFrame(rows, "symbol string, date date, value double, fwd double")


def test_ic_finds_planted_signal_and_rejects_noise(spark):
    good, bad = (RS.daily_ic(_panel(spark, p), "value", "fwd").first() for p in (True, False))
    assert good.ic_t_stat > 4 and abs(bad.ic_t_stat) < 3 and good.ic_days == 60
    few = RS.daily_ic(_panel(spark, True).where(F.col("date") < F.lit(day(3))), "value", "fwd").first()
    assert few.mean_daily_ic is None and few.daily_reason == "too few days"


def test_bootstrap_interval_and_repeatability(spark):
    p = _panel(spark, True)
    a, b = RS.bootstrap_spread(p, "value", "fwd", 60).first(), RS.bootstrap_spread(p.repartition(7), "value", "fwd", 60).first()
    assert a.spread_ci_lo_pct > 0 and a.spread_ci_hi_pct == pytest.approx(b.spread_ci_hi_pct, rel=1e-12)


def test_bh_known_vector(spark):
    ps = [0.01, 0.04, 0.03, 0.005, None]
    df = spark.createDataFrame([(f"h{i}", p) for i, p in enumerate(ps)], "name string, p double")
    got = {r.name: (r.p_adj, r.reject) for r in RS.bh_fdr(df, alpha=0.03).collect()}
    assert [got[f"h{i}"][0] for i in range(4)] == pytest.approx([0.02, 0.04, 0.04, 0.02]) and got["h4"] == (None, False)
    assert [got[f"h{i}"][1] for i in range(4)] == [True, False, False, True]


def test_cpcv_train_and_test_are_disjoint_and_complete(spark):
    f = RS.cpcv(spark.createDataFrame([(day(i),) for i in range(103)], "date date"), 6, 2, 0.02)
    per = f.groupBy("fold").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "test").alias("t"), F.count_distinct("date").alias("d")).collect()
    assert len(per) == 15 and all(r.n == r.d == 103 and 34 <= r.t <= 36 for r in per)


def test_order_shuffle_final_return_does_not_depend_on_order(spark):
    t = spark.createDataFrame([(i, 0.01 if i % 3 else -0.02) for i in range(60)], "id int, pnl double")
    r = RS.order_shuffle_drawdown(t, "id", "pnl", 5).collect()
    want = 100 * (1.01 ** 40 * 0.98 ** 20 - 1)
    assert all(x.final_return_pct == pytest.approx(want) and x.mdd_pct <= 0 for x in r)


# --- registry, quality, text, streams --------------------------------------------------------

def test_contracts_raise(spark):
    ok = spark.createDataFrame([("A", day(0), 1.0)], "symbol string, date date, value double")
    RG.Signal(ok, "s")
    for bad in (ok.union(ok), ok.withColumn("value", F.lit(float("nan"))), ok.drop("value"), ok.where("false")):
        with pytest.raises(ValueError):
            RG.Signal(bad, "s")


def test_compare_never_crosses_universes(spark):
    cols = "input_name string, evaluation string, horizon int, statistic string, value double, universe_hash string, created_at date"
    reg = spark.createDataFrame([("a", "ic", 5, "m", 0.1, "u1", day(0)), ("a", "ic", 5, "m", 0.2, "u1", day(1)), ("b", "ic", 5, "m", 0.1, "u1", day(0))], cols)
    new = spark.createDataFrame([("a", "ic", 5, "m", 0.203, "u1", day(2)), ("b", "ic", 5, "m", 0.1, "u2", day(2)), ("c", "ic", 5, "m", 0.1, "u1", day(2))], cols).drop("created_at")
    assert {r.input_name: r.status for r in RG.compare(new, reg).collect()} == {"a": "within_tol", "b": "universe_mismatch", "c": "no_baseline"}


def test_validation_severities(spark):
    df = spark.createDataFrame([(None, day(0), 5.0), ("A", day(9), 500.0), ("B", day(0), 1.0)], "symbol string, date date, close double")
    got = {r.check: r.severity for r in V.validate(df, V.TableSchema(("symbol", "gone"), ("symbol",), "date", {"close": (0, 100)}), "t", day(5), previous_rows=100).collect()}
    assert got == {"not_empty": "ok", "required_cols": "error", "nulls:symbol": "warning", "future_dates": "warning", "range:close": "warning", "row_count": "warning"}
    empty = V.verdict(V.validate(df.where("false"), V.TableSchema(), "t", day(5))).first()
    assert empty.status == "NO DATA"


def test_mentions_need_boundaries_cashtags_count_bare_tickers_do_not(spark):
    al = spark.createDataFrame([("XOM", "Exxon Mobil"), ("V", "Visa")], "symbol string, alias string")
    tx = spark.createDataFrame([(1, "EXXON MOBIL rises; $V falls"), (2, "exxon  mobil"), (3, "visas and V"), (4, "(NYSE: xom) up"), (5, "$Visa"), (6, "évisa"), (7, None), (8, "Visa")], "id int, t string")
    got = sorted((r.id, r.symbol) for r in TX.mentions(tx, "id", "t", al).collect())
    assert got == [(1, "V"), (1, "XOM"), (4, "XOM"), (8, "V")]


def test_alias_suffixes_strip_twice(spark):
    n = spark.createDataFrame([("GS", "Goldman Sachs Group Inc")], "symbol string, name string")
    assert sorted(r.alias for r in TX.alias_dictionary(n).collect()) == ["Goldman Sachs", "Goldman Sachs Group", "Goldman Sachs Group Inc"]


def test_sentiment_of_headline_and_summary(spark):
    lex = spark.createDataFrame([("surge", 2.5), ("fraud", -3.0)], "word string, valence double")
    tx = spark.createDataFrame([(1, "Shares surge", ""), (2, "Shares surge", "fraud fraud fraud"), (3, "Nothing here", "")], "id int, h string, s string")
    got = {r.id: r for r in TX.article_sentiment(tx, "id", "h", "s", lex).collect()}
    sq = lambda v: v / math.sqrt(v * v + 15)
    assert got[1].score == pytest.approx(sq(2.5)) and got[1].sentiment == "bullish"
    assert got[2].score == pytest.approx(0.7 * sq(2.5) + 0.3 * sq(-9)) and got[3].sentiment == "neutral" and got[3].confidence == 1.0


def test_sinks_refuse_shadowed_partition_columns(spark, tmp_path):
    from tidemark.sources.sinks import write_partitioned
    with pytest.raises(ValueError):
        write_partitioned(spark.range(1).withColumn("year", F.lit(1)), str(tmp_path))


def test_catalog_rejects_unknown_names(spark):
    from tidemark.sources.catalog import Catalog
    with pytest.raises(KeyError):
        Catalog.warehouse(spark, "/root/testdata/sf0.001").load("nope")

# --- hostile inputs --------------------------------------------------------------------------

def test_positions_and_ranks_survive_nan_infinities_and_one_value(spark):
    rnd = random.Random(4)
    vals = [float("nan"), float("inf"), float("-inf"), None, -0.0, 0.0, 100.25, 100.26, *([7.0] * 300), *(rnd.uniform(100, 101) for _ in range(200))]
    rows = [("g", f"s{i:04d}", v) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g string, s string, v double").repartition(5)
    real = sorted((v, s) for _, s, v in rows if v is not None and not math.isnan(v))
    got = {r.s: (r.p, r.p_of) for r in U.position_within(df, ["g"], "v", "s", "p").collect()}
    assert got == {s: (i + 1, len(real)) for i, (_, s) in enumerate(real)}
    want = pd.Series([v for v, _ in real]).rank()
    ranks = {r.s: r.r for r in U.average_rank(df, ["g"], "v", "r").collect()}
    assert ranks == {s: x for (_, s), x in zip(real, want)}


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile_of_repeated_values(spark, q):
    vals = [1.0, 2.0, 2.0, 2.0, 5.0, 9.0, 9.0, None, float("nan")]
    df = spark.createDataFrame([("a", v) for v in vals] + [("b", 3.0)], "k string, v double")
    got = {r.k: r.x for r in U.exact_quantile(df, ["k"], "v", q, "x").collect()}
    assert got == pytest.approx({"a": np.quantile([v for v in vals if v is not None and not math.isnan(v)], q), "b": 3.0})


@pytest.mark.parametrize("forward,strict,repeated", [(False, False, False), (True, False, False), (False, True, True), (True, True, True)])
def test_null_keys_match_nothing(spark, forward, strict, repeated):
    L = spark.createDataFrame([(None, day(5), 1), ("a", day(5), 2), ("a", day(5), 3), ("a", None, 4)], "k string, t date, id int")
    R = spark.createDataFrame([(None, day(5), 8), (None, day(4), 9), ("a", day(4), 10), ("a", day(6), 11)], "k string, rt date, v int")
    got = {r.id: r.v for r in AS.asof_join(L, R, ["k"], "t", "rt", ["v"], forward=forward, strict=strict, repeated=repeated).collect()}
    assert len(got) == 4 and got[1] is None and got[2] == got[3] == (11 if forward else 10)
    p = spark.createDataFrame([(None, day(9)), ("a", day(9))], "symbol string, date date")
    e = spark.createDataFrame([(None, day(9), 1.0), ("a", day(9), 2.0)], "symbol string, d date, x double")
    out = {r.symbol: (r.s, r.n) for r in AS.trailing_range_agg(p, e, "symbol", "date", "d", {"s": F.col("x")}, 9, {"n": F.col("x")}).collect()}
    assert out == {None: (None, 0), "a": (2.0, 1)}


def test_latest_row_with_a_map_column_and_null_recency(spark):
    df = spark.createDataFrame([(1, None, {"a": 1}), (1, 5, {"b": 2}), (1, 5, {"a": 2}), (2, None, None), (None, 1, {"c": 1})], "k int, t int, m map<string,int>")
    assert {r.k: r.m for r in D.keep_latest(df, ["k"], ["t"]).collect()} == {1: {"b": 2}, 2: None, None: {"c": 1}}


def test_every_topic_and_long_aliases_are_found(spark):
    text = "Earnings guidance: analysts see a merger, a dividend and a buyback; lawsuits over tariffs"
    tags = spark.createDataFrame([(text,)], "t string").select(TX.topic_tags(F.col("t")).alias("x")).first().x
    assert tags == ["earnings", "guidance", "analyst", "merger", "dividend", "buyback", "legal", "regulation"]
    name = "The Very Old (and Quite Long) International Bank of Something \\E & Sons, Ltd."
    al = spark.createDataFrame([("L", name), ("I", "IBM"), ("P", "(x) Co"), ("E", "")], "symbol string, alias string")
    tx = spark.createDataFrame([(1, f"so {name.upper()} fell"), (2, name[:-3]), (3, "ibm"), (4, "the very old"), (5, "my (X) CO is"), (6, "the very old ibmx")], "id int, t string")
    assert sorted((r.id, r.symbol) for r in TX.mentions(tx, "id", "t", al).collect()) == [(1, "L"), (3, "I"), (5, "P")]


def test_bands_and_stops_equal_the_bar_by_bar_rule(spark):
    b = bars_frame(spark, 150).where("NOT (symbol = 'B' AND date < date'2020-01-20')")
    st = TE.supertrend(b).toPandas().sort_values(["symbol", "date"])
    tr = TE.trailing_stop(b, 2.0).toPandas().sort_values(["symbol", "date"])
    atr = TE.simple_atr(b, 10, "a").toPandas().sort_values(["symbol", "date"])
    for s in "AB":
        g = st[st.symbol == s]
        mid, band = (g.high + g.low).to_numpy() / 2, 3 * g.st_atr.to_numpy()
        c, side, lo, hi = g.close.to_numpy(), 1, math.nan, math.nan
        for i in range(len(g)):
            low, high = mid[i] - band[i], mid[i] + band[i]
            lo = max(low, lo) if i and c[i - 1] > mid[i - 1] - band[i - 1] else low
            hi = min(high, hi) if i and c[i - 1] < mid[i - 1] + band[i - 1] else high
            side = 1 if c[i] > hi else -1 if c[i] < lo else side
            want = lo if side > 0 else hi
            assert g.direction.iloc[i] == -side and (math.isnan(want) and pd.isna(g.st_line.iloc[i]) or g.st_line.iloc[i] == pytest.approx(want))
        t, loss = tr[tr.symbol == s], 2 * atr[atr.symbol == s].a.fillna(0).to_numpy()
        stop = c[0]
        for i in range(1, len(t)):
            above, was = c[i] > stop, c[i - 1] > stop
            if above:
                stop = max(stop, c[i] - loss[i]) if was else c[i] - loss[i]
            else:
                stop = min(stop, c[i] + loss[i]) if c[i] < stop and c[i - 1] < stop else c[i] + loss[i]
            assert t.trail.iloc[i] == pytest.approx(stop)


def test_dividend_score_of_missing_metrics(spark):
    cols = "symbol string, category string, yield_ttm double, growth double, payout double, payout_annual double, beta double, roe double, margin double, dps double"
    df = spark.createDataFrame([("a", "Other", 5.0, *[None] * 7), ("b", "Other", 5.0, None, 0.0, 50.0, None, None, None, 1.0)], cols)
    got = {r.symbol: r for r in RP.dividend_score(df).collect()}
    assert (got["a"].score, got["b"].score) == (0.0, 35.0) and got["a"].beta is None and got["b"].payout == 0.0


def test_option_source_falls_back_for_each_symbol(spark):
    broker = spark.createDataFrame([("A", day(1), day(9), "call", 1.0, 0.5)], "symbol string, date date, expiration date, put_call string, strike double, implied_volatility double")
    vendor = spark.createDataFrame([("A", day(5), day(9), "put", 1.0, 0.1), ("B", day(5), day(9), "put", 1.0, 0.2), ("B", day(4), day(9), "put", 1.0, 0.3)], "symbol string, date date, expiration date, contract_type string, strike_price double, volatility double")
    got = {(r.symbol, r.source, r.date, r.iv) for r in OP.iv_source({"broker_chain": broker, "vendor_chain": vendor}).collect()}
    assert got == {("A", "broker_chain", day(1), 0.5), ("B", "vendor_chain", day(5), 0.2)}


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    from tidemark.streaming import feeds as SF
    t0, schema = dt.datetime(2024, 1, 1), "key bigint, ts timestamp_ntz, value double"
    files = [[(1, 0, 150.0), (2, 0, 1.0)], [(1, 1, 160.0), (3, 5, 120.0)], [(1, 2, 90.0), (1, 3, 170.0), (2, 1, 2.0)]]
    table, ck2 = (str(tmp_path / x) for x in ("table", "ck2"))
    seen = []
    for part in files:
        spark.createDataFrame([(k, t0 + dt.timedelta(hours=h), v) for k, h, v in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = lambda: SF.file_stream(spark, str(tmp_path / "in"), "*.parquet", schema, 1)
        latest = SF.upsert_latest(src(), ["key"], ["ts"], table, ck2, buckets=2)
        seen.append({r.key: r.value for r in latest.collect()})
    assert seen == [{1: 150.0, 2: 1.0}, {1: 160.0, 2: 1.0, 3: 120.0}, {1: 170.0, 2: 2.0, 3: 120.0}]
    again = SF.upsert_latest(src(), ["key"], ["ts"], table, ck2, buckets=2)  # nothing new arrived
    assert {r.key: r.value for r in again.collect()} == seen[-1]


def test_late_rows_and_sliding_windows(spark, tmp_path):
    from tidemark.streaming import feeds as SF
    t0, schema = dt.datetime(2024, 1, 1), "mmsi bigint, ts timestamp, zone string, speed double, nav_status string"
    files = [[(1, 10), (2, 20), (1, 40)], [(3, 400)], [(3, 405)], [(9, 15), (3, 410)]]  # minutes; the last file holds a row behind the watermark
    for part in files:
        rows = [(m, t0 + dt.timedelta(minutes=x), "z", 1.0, "Under way") for m, x in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = SF.file_stream(spark, str(tmp_path / "in"), "*.parquet", schema, 1)
    parts = SF.drain(SF.zone_windows(src, "1 hour", "30 minutes"), "update")
    got = {(r.window_start - t0).total_seconds() / 60: (r.position_reports, r.vessels) for r in SF.zone_summary(SF.latest_update(parts, ["window_start", "zone", "mmsi"])).collect()}
    assert got == {-30: (2, 2), 0: (3, 2), 30: (1, 1), 360: (3, 1), 390: (3, 1)}
