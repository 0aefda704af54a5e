"""Portfolio, event-study, pairing and exposure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as FE, portfolio as PF, studies as ST, technical as TE
from tidemark.plans.base import query, r, rounded
from tidemark.plans.sqlbits import BARS, FACTS, MACRO, NEWS, R, t_tail
from tidemark.plans.windows import market
from tidemark.sources import adapters as A
from tidemark.sources.workspace import materialise

_W = "(PARTITION BY symbol ORDER BY date)"
SCORE_SQL = f"""{BARS}, sc AS MATERIALIZED (SELECT symbol, date, close, close / lag(close) OVER {_W} - 1 AS ret, round(close / lag(close, 21) OVER {_W} - 1, 9) AS score FROM bars)"""


def scored(spark, d):
    f = FE.returns(A.bars(spark, d).select("symbol", "date", "close"), (1, 21))
    return f.select("symbol", "date", "close", F.col("ret_1d").alias("ret"), F.round("ret_21d", 9).alias("score"))


_TGT = """cal AS (SELECT DISTINCT date FROM bars), rb AS (SELECT max(date) AS rebal FROM cal GROUP BY date_trunc('month', date)),
  sd AS (SELECT rebal, (SELECT max(date) FROM sc WHERE score IS NOT NULL AND date <= rebal) AS scored FROM rb),
  cs AS (SELECT rebal, symbol, score, row_number() OVER (PARTITION BY rebal ORDER BY score DESC, symbol) AS pos, count(*) OVER (PARTITION BY rebal) AS n FROM sd JOIN sc ON sc.date = sd.scored WHERE score IS NOT NULL),
  kk AS (SELECT *, greatest(1, CAST(round_even(n / 5.0::DOUBLE, 0) AS INTEGER)) AS k FROM cs WHERE n >= 2),
  tg AS MATERIALIZED (SELECT rebal, symbol, CASE WHEN pos <= k THEN 1.0::DOUBLE / k ELSE 0 END - CASE WHEN pos > n - k THEN 1.0::DOUBLE / k ELSE 0 END AS weight FROM kk WHERE pos <= k OR pos > n - k)"""


def targets(spark, d, s=None):
    s = scored(spark, d) if s is None else s
    rebal = PF.rebalance_dates(s.select("date").distinct(), "month")
    return PF.target_weights(s, rebal, 5)


@query("P5_target_weights", f"WITH {SCORE_SQL}, {_TGT} SELECT rebal, symbol, {R('weight')} AS weight FROM tg WHERE weight <> 0")
def _(spark, d):
    return rounded(targets(spark, d), ["weight"])


_HELD = """hd AS MATERIALIZED (SELECT c.date, t.symbol, t.weight FROM (SELECT date, (SELECT max(rebal) FROM tg WHERE rebal < date) AS rebal FROM cal) c JOIN tg t USING (rebal)),
  gr AS MATERIALIZED (SELECT cal.date, coalesce(sum(weight * ret), 0) AS gross FROM cal LEFT JOIN (SELECT hd.date, weight, ret FROM hd JOIN sc USING (date, symbol) WHERE ret IS NOT NULL) x USING (date) GROUP BY 1)"""


def book(spark, d):
    """Calendar, held weights and gross returns of the demo strategy."""
    s = materialise(scored(spark, d), "scored")
    days = s.select("date").distinct()
    held = PF.holdings_by_day(days, targets(spark, d, s))
    return days, held, PF.portfolio_returns(days, held, s.select("date", "symbol", "ret"))


@query("P6_portfolio_returns", f"WITH {SCORE_SQL}, {_TGT}, {_HELD} SELECT date, {R('gross', 8)} AS gross FROM gr")
def _(spark, d):
    return rounded(book(spark, d)[2], ["gross"], 8)


@query("P6_clipped_weights", f"WITH {SCORE_SQL}, {_TGT} SELECT rebal, count(*) AS n, {R('sum(abs(greatest(-0.15, least(0.15, weight))))')} AS gross_exposure FROM tg WHERE weight <> 0 GROUP BY 1")
def _(spark, d):
    return PF.clip_weights(targets(spark, d), 0.15).groupBy("rebal").agg(F.count("*").alias("n"), r(F.sum(F.abs("weight"))).alias("gross_exposure"))


_SCALE = """vs AS MATERIALIZED (SELECT date, gross, lag(v) OVER (ORDER BY date) AS v1 FROM (SELECT date, gross, CASE WHEN count(gross) OVER w >= 5 THEN stddev_samp(gross) OVER w END * sqrt(252) AS v FROM gr WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW))),
  sl AS MATERIALIZED (SELECT date, gross, CASE WHEN v1 > 1e-12 THEN least(0.5 / v1, 2.0) ELSE 1.0 END::DOUBLE AS scale FROM vs)"""


@query("P7_vol_target", f"WITH {SCORE_SQL}, {_TGT}, {_HELD}, {_SCALE} SELECT date, {R('scale')} AS scale, {R('gross * scale', 8)} AS scaled FROM sl")
def _(spark, d):
    _days, _held, gross = book(spark, d)
    return gross.join(PF.vol_scale(gross, 0.5), "date").select("date", r("scale").alias("scale"), r(F.col("gross") * F.col("scale"), 8).alias("scaled"))


_TURN = """nx AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM cal), ch AS (SELECT date, symbol, sum(w) AS dw FROM (SELECT date, symbol, weight AS w FROM hd UNION ALL SELECT nxt, symbol, -weight FROM hd JOIN nx USING (date) WHERE nxt IS NOT NULL) GROUP BY 1, 2),
  tn AS MATERIALIZED (SELECT cal.date, coalesce(t.turnover, 0) AS turnover, coalesce(s.short_exposure, 0) AS short_exposure FROM cal LEFT JOIN (SELECT date, sum(abs(dw)) AS turnover FROM ch GROUP BY 1) t USING (date)
    LEFT JOIN (SELECT date, sum(CASE WHEN weight < 0 THEN -weight ELSE 0 END) AS short_exposure FROM hd GROUP BY 1) s USING (date)),
  cs2 AS MATERIALIZED (SELECT *, turnover * ((5 + 4 / 2.0) / 1e4) + short_exposure * (30 / (1e4 * 252)) + sqrt(turnover) * (10 / 1e4) AS cost FROM (SELECT date, CASE WHEN turnover > 1e-12 THEN turnover ELSE 0 END AS turnover, short_exposure FROM tn))"""


def costed(spark, d):
    days, held, gross = book(spark, d)
    t = PF.daily_turnover(days, held)
    return gross.join(t.withColumn("cost", PF.cost_of(F.col("turnover"), F.col("short_exposure"), 5, 4, 30, 10)), "date")


@query("P8_turnover_and_costs", f"WITH {SCORE_SQL}, {_TGT}, {_HELD}, {_TURN} SELECT date, {R('turnover')} AS turnover, {R('short_exposure')} AS short_exposure, {R('cost', 8)} AS cost FROM cs2")
def _(spark, d):
    return costed(spark, d).select("date", r("turnover").alias("turnover"), r("short_exposure").alias("short_exposure"), r("cost", 8).alias("cost"))


@query("P9_drawdown_stop", f"""WITH {SCORE_SQL}, {_TGT}, {_HELD}, eq AS (SELECT date, gross, product(1 + gross) OVER (ORDER BY date) AS e FROM gr), pk AS (SELECT *, e / max(e) OVER (ORDER BY date) - 1 AS dd FROM eq), st AS (SELECT min(date) AS s FROM pk WHERE dd < -0.3)
  SELECT date, {R("CASE WHEN date > s THEN 0 ELSE gross END", 8)} AS ret FROM pk, st""")
def _(spark, d):
    g = book(spark, d)[2].select(F.lit("demo").alias("strategy"), "date", F.col("gross").alias("ret"))
    return PF.drawdown_stop(g, 0.3).select("date", r("ret", 8).alias("ret"))


# every symbol is a strategy: its own daily returns, made small so that equity stays positive
STRAT_SQL = f"""{BARS}, rs AS MATERIALIZED (SELECT symbol AS strategy, date, (close / lag(close) OVER {_W} - 1) / 20 AS ret FROM bars), sr AS MATERIALIZED (SELECT * FROM rs WHERE ret IS NOT NULL)"""


def strategies(spark, d):
    f = FE.returns(A.bars(spark, d).select("symbol", "date", "close"), (1,))
    return f.where("ret_1d is not null").select(F.col("symbol").alias("strategy"), "date", (F.col("ret_1d") / 20).alias("ret"))


_PERF = ["total_return_pct", "cagr_pct", "ann_vol_pct", "sharpe", "max_drawdown_pct", "hit_rate_pct", "sortino", "calmar", "omega", "var_95_pct", "cvar_95_pct", "gain_to_pain"]


@query("P10_performance", f"""WITH {STRAT_SQL}, e AS (SELECT *, product(1 + ret) OVER w AS eq FROM sr WINDOW w AS (PARTITION BY strategy ORDER BY date)), dd AS (SELECT *, eq / max(eq) OVER (PARTITION BY strategy ORDER BY date) - 1 AS dd, quantile_cont(ret, 0.05) OVER (PARTITION BY strategy) AS q FROM e),
  a AS (SELECT strategy, count(*) AS n_days, arg_max(eq, date) AS eq, avg(ret) AS m, stddev_pop(ret) * sqrt(252) AS v, min(dd) AS mdd, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS h, sqrt(avg(ret * ret) FILTER (ret < 0)) AS dn, coalesce(sum(ret) FILTER (ret > 0), 0) AS g,
   -coalesce(sum(ret) FILTER (ret < 0), 0) AS l, any_value(q) AS q, avg(ret) FILTER (ret <= q) AS tl FROM dd GROUP BY 1)
  SELECT strategy, n_days, {R('100 * (eq - 1)', 4)} AS total_return_pct, {R('100 * (pow(eq, 252.0 / n_days) - 1)', 4)} AS cagr_pct, {R('100 * v', 4)} AS ann_vol_pct, {R('m * 252 / v', 4)} AS sharpe, {R('100 * mdd', 4)} AS max_drawdown_pct, {R('100 * h', 4)} AS hit_rate_pct,
   {R('m * 252 / (dn * sqrt(252))', 4)} AS sortino, {R('(pow(eq, 252.0 / n_days) - 1) / -mdd', 4)} AS calmar, {R('g / l', 4)} AS omega, {R('-100 * q', 4)} AS var_95_pct, {R('-100 * tl', 4)} AS cvar_95_pct, {R('(g - l) / l', 4)} AS gain_to_pain FROM a""")
def _(spark, d):
    return rounded(PF.performance(strategies(spark, d)), _PERF, 4)


_MK = "mk AS MATERIALIZED (SELECT date, avg(ret) AS bench FROM sr GROUP BY 1)"


def market_ret(s):
    return s.groupBy("date").agg(F.avg("ret").alias("bench"))


@query("P11_equal_weight_benchmark", f"WITH {STRAT_SQL}, {_MK} SELECT date, {R('bench', 8)} AS bench, {R('product(1 + bench) OVER (ORDER BY date)')} AS equity FROM mk")
def _(spark, d):
    b = market_ret(strategies(spark, d)).select(F.lit("m").alias("strategy"), "date", F.col("bench").alias("ret"))
    return PF.equity_curve(b).select("date", r("ret", 8).alias("bench"), r("equity").alias("equity"))


@query("P12_factor_attribution", f"""WITH {STRAT_SQL}, {_MK}, {MACRO}, f2 AS (SELECT date, (value - 50) / 1000 AS smb FROM macro WHERE series_id = 'click'), j AS (SELECT strategy, ret AS y, bench AS x, smb AS z FROM sr JOIN mk USING (date) JOIN f2 USING (date)),
  a AS (SELECT strategy, count(*) AS n, avg(y) AS my, avg(x) AS mx, avg(z) AS mz, covar_pop(x, y) AS sxy, covar_pop(z, y) AS szy, covar_pop(x, z) AS sxz, var_pop(x) AS sxx, var_pop(z) AS szz, var_pop(y) AS syy FROM j GROUP BY 1 HAVING count(*) >= 30),
  b AS (SELECT *, (sxy * szz - szy * sxz) / (sxx * szz - sxz * sxz) AS bx, (szy * sxx - sxy * sxz) / (sxx * szz - sxz * sxz) AS bz FROM a)
  SELECT strategy, CAST(n AS DOUBLE) AS n, {R('(my - bx * mx - bz * mz) * 252 * 100', 3)} AS alpha_ann, {R('(bx * sxy + bz * szy) / syy', 4)} AS r_squared, {R('bx', 3)} AS beta_mkt, {R('bz', 3)} AS beta_smb FROM b""")
def _(spark, d):
    s = strategies(spark, d)
    smb = A.macro(spark, d).where("series_id = 'click'").select("date", ((F.col("value") - 50) / 1000).alias("smb"))
    f = market_ret(s).withColumnRenamed("bench", "mkt").join(smb, "date")
    return rounded(rounded(PF.factor_attribution(s, f, ["mkt", "smb"]), ["alpha_ann", "beta_mkt", "beta_smb"], 3), ["r_squared"], 4)


_BS = ["beta", "alpha_ann_pct", "r_squared", "correlation", "tracking_error_pct", "information_ratio", "up_capture_pct", "down_capture_pct"]


@query("P13_benchmark_stats", f"""WITH {STRAT_SQL}, {_MK}, j AS (SELECT strategy, ret AS s, bench AS b FROM sr JOIN mk USING (date)), a AS (SELECT strategy, count(*) AS n_overlap, covar_samp(s, b) / var_samp(b) AS beta, avg(s) AS ms, avg(b) AS mb, corr(s, b) AS c, stddev_samp(s - b) * sqrt(252) AS te, avg(s - b) AS md,
   avg(s) FILTER (b > 0) / avg(b) FILTER (b > 0) AS u, avg(s) FILTER (b < 0) / avg(b) FILTER (b < 0) AS dn FROM j GROUP BY 1)
  SELECT strategy, n_overlap, {R('beta', 4)} AS beta, {R('(ms - beta * mb) * 252 * 100', 4)} AS alpha_ann_pct, {R('c * c')} AS r_squared, {R('c')} AS correlation, {R('te * 100', 4)} AS tracking_error_pct, {R('md * 252 / te', 4)} AS information_ratio, {R('100 * u', 3)} AS up_capture_pct, {R('100 * dn', 3)} AS down_capture_pct FROM a WHERE n_overlap >= 30""")
def _(spark, d):
    s = strategies(spark, d)
    b = PF.benchmark_stats(s, market_ret(s)).where("bench_reason is null").drop("bench_reason")
    return rounded(rounded(rounded(b, ["beta", "alpha_ann_pct", "tracking_error_pct", "information_ratio"], 4), ["r_squared", "correlation"]), ["up_capture_pct", "down_capture_pct"], 3)


_MON = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


@query("P14_monthly_table", f"""WITH {STRAT_SQL}, m AS (SELECT strategy, CAST(year(date) AS INTEGER) AS obs_year, month(date) AS m, product(1 + ret) - 1 AS r FROM sr GROUP BY ALL)
  SELECT strategy, obs_year, {', '.join(f"{R(f'max(r) FILTER (m = {i + 1}) * 100', 4)} AS {n}" for i, n in enumerate(_MON))}, {R('(product(1 + r) - 1) * 100', 4)} AS ytd FROM m GROUP BY 1, 2""")
def _(spark, d):
    return rounded(PF.monthly_table(strategies(spark, d)), [*_MON, "ytd"], 4)


@query("P15_realised_returns", f"""WITH t AS (SELECT o_orderstatus AS strategy, CAST(o_orderdate AS DATE) AS date, sum(CAST(o_totalprice - 250000 AS DECIMAL(18,2))) AS pnl FROM orders GROUP BY 1, 2),
  c AS (SELECT strategy, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM t GROUP BY 1), j AS (SELECT c.strategy, c.date, coalesce(CAST(pnl AS DOUBLE), 0) AS pnl FROM c LEFT JOIN t USING (strategy, date) WHERE isodow(c.date) <= 5),
  e AS (SELECT *, 1e9 + sum(pnl) OVER (PARTITION BY strategy ORDER BY date) AS equity FROM j) SELECT strategy, date, {R('equity', 2)} AS equity, {R('equity / coalesce(lag(equity) OVER (PARTITION BY strategy ORDER BY date), 1e9) - 1', 9)} AS ret FROM e""")
def _(spark, d):
    t = A.table(spark, d, "orders").select(F.col("o_orderstatus").alias("strategy"), F.to_date("o_orderdate").alias("exit_date"), (F.col("o_totalprice") - 250000).cast("decimal(18,2)").alias("pnl"))
    return PF.realised_returns(t, 1e9).select("strategy", "date", r("equity", 2).alias("equity"), r("ret", 9).alias("ret"))


# --- event studies ---------------------------------------------------------------------------

PRE, POST = -2, 10
EV_SQL = f"""{BARS}, {NEWS}, bx AS MATERIALIZED (SELECT symbol, date, close, row_number() OVER {_W} AS i FROM bars), bm AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) AS i, sum(CAST(close * 10000 AS BIGINT)) / count(*)::DOUBLE / 10000 AS bench FROM bars GROUP BY 1),
  ev AS (SELECT article_id, symbol, date, topic AS label FROM news WHERE score > 0.2), d0 AS (SELECT ev.*, bx.date AS first, bx.i FROM ev ASOF LEFT JOIN bx ON ev.symbol = bx.symbol AND ev.date <= bx.date),
  dd AS (SELECT d0.article_id, d0.symbol, d0.date, d0.label, d0.i + 1 AS i, bx.date AS day0 FROM d0 JOIN bx ON bx.symbol = d0.symbol AND bx.i = d0.i + 1 WHERE bx.date - d0.date <= 15),
  pt AS (SELECT dd.article_id, dd.symbol, dd.date, dd.label, dd.day0, CAST(p.i - dd.i AS INTEGER) AS rel, p.close / q.close - 1 AS own, bp.bench / bq.bench - 1 AS mkt FROM dd JOIN bx p ON p.symbol = dd.symbol AND p.i BETWEEN dd.i - 2 AND dd.i + 10 JOIN bx q ON q.symbol = dd.symbol AND q.i = dd.i - 1
     JOIN bm b0 ON b0.date = dd.day0 JOIN bm bp ON bp.i = b0.i + (p.i - dd.i) JOIN bm bq ON bq.i = b0.i - 1),
  car AS MATERIALIZED (SELECT article_id, symbol, date, label, day0, rel, own - mkt AS car FROM pt WHERE article_id IN (SELECT article_id FROM pt GROUP BY 1 HAVING count(*) = 13))"""


def event_set(spark, d):
    return A.news(spark, d).where("score > 0.2").select("article_id", "symbol", "date", F.col("topic").alias("label"))


def closes(spark, d):
    """Daily closes, written once: the paths and the market read them."""
    return materialise(A.bars(spark, d).select("symbol", "date", "close"), "closes")


def paths(spark, d):
    b = closes(spark, d)
    # summaries read the paths for several aggregates and for the exact median
    return materialise(ST.event_paths(event_set(spark, d), b, PRE, POST, market(b), entry_lag=1), "paths")


def cars(spark, d):
    return ST.car_rows(paths(spark, d), PRE, ["article_id", "symbol", "date", "label", "day0"])


@query("E1_event_study_paths", f"WITH {EV_SQL} SELECT article_id, day0, rel, {R('car')} AS car FROM car")
def _(spark, d):
    return cars(spark, d).select("article_id", "day0", "rel", r("car").alias("car"))


_HT = f"count(*) AS n, {R('100 * avg(car)', 4)} AS mean_pct, {R('100 * quantile_cont(car, 0.5)', 4)} AS median_pct, {R('100 * avg((car > 0)::INT)', 4)} AS hit_rate_pct, {R('avg(car) / (stddev_samp(car) / sqrt(count(*)))', 4)} AS t_stat"


@query("E2_horizon_table", f"""WITH {EV_SQL}, h AS (SELECT rel, {_HT} FROM car WHERE rel IN (1, 3, 5, 10) GROUP BY 1), dr AS (SELECT date, avg(r) AS r FROM (SELECT date, close / lag(close) OVER {_W} - 1 AS r FROM bars) GROUP BY 1 HAVING avg(r) IS NOT NULL),
  bl AS ({' UNION ALL '.join(f"SELECT {h} AS rel, avg(CASE WHEN c >= {h} THEN p END) - 1 AS b FROM (SELECT count(r) OVER w AS c, product(1 + r) OVER w AS p FROM dr WINDOW w AS (ORDER BY date ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW))" for h in (1, 3, 5, 10))})
  SELECT h.*, {R('100 * b', 4)} AS baseline_pct FROM h JOIN bl USING (rel)""")
def _(spark, d):
    c = cars(spark, d).where(F.col("rel").isin(1, 3, 5, 10))
    t = ST.horizon_table(c).join(ST.baseline(A.bars(spark, d), [1, 3, 5, 10]), "rel")
    return rounded(t.withColumn("baseline_pct", 100 * F.col("baseline")).drop("baseline"), ["mean_pct", "median_pct", "hit_rate_pct", "t_stat", "baseline_pct"], 4)


@query("E3_filing_events", f"WITH {FACTS} SELECT symbol, filed AS date, form AS label, count(*) AS n FROM facts WHERE form IN ('10-K', '8-K') GROUP BY 1, 2, 3")
def _(spark, d):
    f = A.facts(spark, d).where(F.col("form").isin("10-K", "8-K"))
    return f.groupBy("symbol", F.col("filed").alias("date"), F.col("form").alias("label")).agg(F.count("*").alias("n"))


@query("E3_earnings_surprise_events", f"""WITH {FACTS}, e AS (SELECT symbol, filed AS date, max(value) AS actual FROM facts WHERE metric = 'eps' GROUP BY 1, 2), p AS (SELECT *, lag(actual) OVER {_W} AS estimate FROM e)
  SELECT symbol, date, {R('(actual - estimate) / abs(estimate) * 100', 1)} AS surprise_pct FROM p WHERE (actual - estimate) / abs(estimate) * 100 >= 10""")
def _(spark, d):
    e = A.facts(spark, d).where("metric = 'eps'").groupBy("symbol", F.col("filed").alias("date")).agg(F.max("value").alias("actual"))
    p = e.withColumn("estimate", F.lag("actual").over(FE.by_symbol()))
    s = (F.col("actual") - F.col("estimate")) / F.abs("estimate") * 100
    return p.withColumn("s", s).where("s >= 10").select("symbol", "date", r("s", 1).alias("surprise_pct"))


@query("E4_per_label_study", f"WITH {EV_SQL} SELECT label, rel, {_HT} FROM car WHERE rel >= 0 GROUP BY 1, 2 HAVING count(*) >= 20")
def _(spark, d):
    t = ST.horizon_table(cars(spark, d).where("rel >= 0"), ["label"], 20)
    return rounded(t, ["mean_pct", "median_pct", "hit_rate_pct", "t_stat"], 4)


_OUT = f"""{EV_SQL}, o1 AS (SELECT article_id, any_value(label) AS signal, any_value(date) AS date, coalesce(min(rel) FILTER (rel BETWEEN 1 AND 10 AND round(car, 9) <= -0.05), 11) AS s, coalesce(min(rel) FILTER (rel BETWEEN 1 AND 10 AND round(car, 9) >= 0.08), 11) AS t FROM car GROUP BY 1),
  o2 AS (SELECT *, least(s, t, 10) AS exit_rel, CASE WHEN least(s, t) > 10 THEN 'time' WHEN s <= t THEN 'stop' ELSE 'target' END AS exit_reason FROM o1), oc AS MATERIALIZED (SELECT o2.article_id, signal, o2.date, exit_rel, exit_reason, round(car, 9) - 0.001 AS ret FROM o2 JOIN car ON car.article_id = o2.article_id AND car.rel = exit_rel)"""


def outcomes(spark, d):
    p = paths(spark, d).withColumn("path", F.slice(F.transform("path", lambda x: F.round(x, 9)), 1 - PRE, POST + 1))  # from day 0 on
    return ST.exit_outcomes(p.withColumnRenamed("label", "signal"), POST, 5, 8, 1, 0.001)


@query("E5_exit_outcomes", f"WITH {_OUT} SELECT article_id, exit_rel, exit_reason, {R('ret')} AS ret FROM oc")
def _(spark, d):
    return outcomes(spark, d).select("article_id", "exit_rel", "exit_reason", r("ret").alias("ret"))


_OS = f"count(*) AS n_trades, {R('100 * avg((ret > 0)::INT)', 4)} AS win_rate_pct, {R('100 * avg(ret)', 4)} AS avg_return_pct, {R('100 * quantile_cont(ret, 0.5)', 4)} AS median_return_pct, {R('100 * max(ret)', 4)} AS best_pct, {R('100 * min(ret)', 4)} AS worst_pct, {R('coalesce(sum(ret) FILTER (ret > 0), 0) / -sum(ret) FILTER (ret <= 0)', 4)} AS profit_factor, count(*) FILTER (exit_reason = 'stop') AS stops_hit, count(*) FILTER (exit_reason = 'target') AS targets_hit"
_OSC = ["win_rate_pct", "avg_return_pct", "median_return_pct", "best_pct", "worst_pct", "profit_factor"]


@query("E5_outcome_summary", f"WITH {_OUT} SELECT signal, {_OS} FROM oc GROUP BY 1")
def _(spark, d):
    out = materialise(outcomes(spark, d).select("signal", "exit_reason", "ret"), "outcomes")  # read for the aggregate and for the exact median
    return rounded(ST.outcome_summary(out, ["signal"]), _OSC, 4)


@query("E6_date_level_stats", f"WITH {EV_SQL}, p AS (SELECT rel, date, avg(car) AS m FROM car GROUP BY 1, 2) SELECT rel, count(*) AS n_dates, {R('100 * avg(m)', 4)} AS mean_pct, {R('avg(m) / (stddev_samp(m) / sqrt(count(*)))', 4)} AS t_stat FROM p GROUP BY 1")
def _(spark, d):
    return rounded(ST.date_level(cars(spark, d)), ["mean_pct", "t_stat"], 4)


@query("E6_date_level_p_values", f"""WITH {EV_SQL}, p AS (SELECT rel, date, avg(car) AS m FROM car GROUP BY 1, 2), t AS (SELECT rel, avg(m) / nullif(stddev_samp(m) / sqrt(count(*)), 0) AS t, count(*) - 1 AS v FROM p GROUP BY 1), pv AS (SELECT rel, round(p, 9) AS p FROM {t_tail('t', 't', 'v', 'rel')}),
  rk AS (SELECT *, row_number() OVER (ORDER BY p, rel) AS rk, count(*) OVER () AS m FROM pv), ad AS (SELECT *, least(1, min(p * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj FROM rk)
  SELECT rel, {R('p')} AS p, {R('p_adj')} AS p_adj, rk <= coalesce((SELECT max(rk) FROM ad WHERE p <= 0.1 * rk / m), 0) AS reject FROM ad""")
def _(spark, d):
    from tidemark.functions.distributions import t_two_sided
    from tidemark.operators.research_stats import bh_fdr
    t = ST.date_level(cars(spark, d)).where("t_stat is not null")
    p = t.select("rel", F.round(t_two_sided("t_stat", "n_dates - 1"), 9).alias("p"), F.format_string("h%03d", F.col("rel") - PRE).alias("name"))
    return rounded(bh_fdr(materialise(p, "p-values")).select("rel", "p", "p_adj", "reject"), ["p", "p_adj"])  # the control reads its few rows several times


_OUT21 = _OUT.replace("dd.i + 10", "dd.i + 21").replace("count(*) = 13", "count(*) = 24")


@query("E7_signal_health", f"""WITH {_OUT21}, o21 AS (SELECT oc.*, car.car AS far FROM oc JOIN car ON car.article_id = oc.article_id AND car.rel = 21), w AS (SELECT o21.*, unnest(CASE WHEN date >= DATE '2000-12-31' - 180 THEN ['full','3y','1y','180d'] WHEN date >= DATE '2000-12-31' - 365 THEN ['full','3y','1y'] WHEN date >= DATE '2000-12-31' - 1095 THEN ['full','3y'] ELSE ['full'] END) AS "window" FROM o21),
  m AS (SELECT signal, "window", {_OS}, {R('100 * avg(round(far, 9))', 4)} AS car21_mean_pct, {R('avg(round(far, 9)) / (stddev_samp(round(far, 9)) / sqrt(count(*)))', 4)} AS car21_tstat FROM w GROUP BY 1, 2), f AS (SELECT signal, max(n_trades) FILTER ("window" = '1y') AS n, max(win_rate_pct) FILTER ("window" = 'full') - max(win_rate_pct) FILTER ("window" = '1y') AS dr, max(profit_factor) FILTER ("window" = '1y') AS pf FROM m GROUP BY 1)
  SELECT m.*, coalesce(n >= 10 AND (dr > 10 OR pf < 1), false) AS degraded FROM m JOIN f USING (signal)""")
def _(spark, d):
    """One path of 21 bars an event gives its exit outcome and 21-bar abnormal return; these few columns are written once, for every window."""
    b = closes(spark, d)
    p = ST.event_paths(event_set(spark, d), b, PRE, 21, market(b), entry_lag=1)
    p = p.withColumn("path", F.slice(F.transform("path", lambda x: F.round(x, 9)), 1 - PRE, 22))
    out = ST.exit_outcomes(p.withColumnRenamed("label", "signal").withColumn("far", F.get("path", F.lit(21))), POST, 5, 8, 1, 0.001)
    out = materialise(out.select("signal", "date", "far", "exit_reason", "ret"), "outcomes")
    h = ST.signal_health(out, "2000-12-31", car="far").withColumnsRenamed({"car_mean_pct": "car21_mean_pct", "car_tstat": "car21_tstat"})
    return rounded(h, [*_OSC, "car21_mean_pct", "car21_tstat"], 4)


_CR = f"""rf AS MATERIALIZED (SELECT symbol, date, close, row_number() OVER {_W} AS i, count(*) OVER (PARTITION BY symbol) AS n, coalesce(close > 85 AND lag(close) OVER {_W} <= 85, false) AS en, coalesce(close < 70 AND lag(close) OVER {_W} >= 70, false) AS ex FROM bars),
  nxx AS MATERIALIZED (SELECT *, min(CASE WHEN ex THEN i END) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nex, min(CASE WHEN en THEN i END) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nen FROM rf),
  tr AS (SELECT symbol, nen AS sig, n FROM nxx WHERE i = 1 UNION ALL SELECT t.symbol, z.nen, t.n FROM tr t JOIN nxx x ON x.symbol = t.symbol AND x.i = t.sig + 2 JOIN nxx z ON z.symbol = t.symbol AND z.i = x.nex + 2),
  pr AS (SELECT t.symbol, a.date AS entry_date, a.close AS entry_price, b.date AS exit_date, b.close AS exit_price, CAST(b.i - a.i AS INTEGER) AS days_held FROM tr t JOIN nxx a ON a.symbol = t.symbol AND a.i = t.sig + 1 JOIN nxx x ON x.symbol = t.symbol AND x.i = t.sig + 2 JOIN nxx b ON b.symbol = t.symbol AND b.i = x.nex + 1)"""


def rule_flags(bars):
    c = F.col("close")
    return bars.select(F.col("symbol").alias("key"), "date", "close", TE.cross(c, 85, "up").alias("entry"), TE.cross(c, 70, "down").alias("exit"))


@query("E8_pair_trades", f"WITH RECURSIVE {BARS}, {_CR} SELECT CAST(symbol AS VARCHAR) AS key, entry_date, entry_price, exit_date, exit_price, days_held, {R('100 * (exit_price / entry_price - 1)', 6)} AS pnl_pct FROM pr")
def _(spark, d):
    t = ST.pair_trades(rule_flags(A.bars(spark, d).select("symbol", "date", "close")))
    return rounded(t, ["pnl_pct"]).drop("side", "exit_reason")


@query("E8_trade_summary", f"""WITH RECURSIVE {BARS}, {_CR}, p AS (SELECT *, 100 * (exit_price / entry_price - 1) AS pnl FROM pr) SELECT count(*) AS n_trades, count(*) AS n_long, CAST(0 AS BIGINT) AS n_short, {R('sum(pnl)', 4)} AS total_pnl_pct,
  {R('100 * avg((pnl > 0)::INT)', 4)} AS win_rate_pct, {R('avg(pnl)', 4)} AS avg_pnl_pct, quantile_cont(days_held, 0.5)::DOUBLE AS median_days_held, count(DISTINCT symbol) AS n_keys FROM p""")
def _(spark, d):
    t = ST.pair_trades(rule_flags(A.bars(spark, d).select("symbol", "date", "close")))
    return rounded(ST.trade_summary(t), ["total_pnl_pct", "win_rate_pct", "avg_pnl_pct"], 4)


@query("E9_price_floor", f"WITH {BARS} SELECT symbol, date, coalesce(close > 60 AND lag(close) OVER {_W} <= 60, false) AND close >= 70 AS entry FROM bars")
def _(spark, d):
    c = F.col("close")
    return A.bars(spark, d).select("symbol", "date", (TE.cross(c, 60, "up") & (c >= 70)).alias("entry"))


# --- exposures -------------------------------------------------------------------------------

EX_SQL = f"""{BARS}, {MACRO}, st AS MATERIALIZED (SELECT symbol, date, close / lag(close) OVER {_W} - 1 AS y FROM bars), mkx AS (SELECT date, avg(y) AS m FROM st WHERE y IS NOT NULL GROUP BY 1),
  dr AS (SELECT series_id AS driver, date, v / lag(v) OVER (PARTITION BY series_id ORDER BY date) - 1 AS x FROM (SELECT series_id, date, CASE WHEN value > 0 THEN value END AS v FROM macro)),
  j AS MATERIALIZED (SELECT symbol, driver, date, y, x, m FROM st JOIN mkx USING (date) JOIN dr USING (date) WHERE y IS NOT NULL AND x IS NOT NULL AND m IS NOT NULL)"""
_FIT = """count(*) AS n_obs, covar_pop(x, y) AS sxy, covar_pop(m, y) AS smy, covar_pop(x, m) AS sxm, var_pop(x) AS sxx, var_pop(m) AS smm, var_pop(y) AS syy"""
_FITC = f"""{R('sxy / sxx', 8)} AS beta, {R('(sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n_obs - 2) / sxx)', 4)} AS t_stat, {R('sxy * sxy / sxx / syy', 6)} AS r2"""
_B2 = "((sxy * smm - smy * sxm) / (sxx * smm - sxm * sxm))"
_T2 = f"({_B2} / sqrt((syy - {_B2} * sxy - ((smy * sxx - sxy * sxm) / (sxx * smm - sxm * sxm)) * smy) / (n_obs - 3) * smm / (sxx * smm - sxm * sxm)))"


def exposure_inputs(spark, d):
    f = FE.returns(A.bars(spark, d).select("symbol", "date", "close"), (1,)).where("ret_1d is not null")
    stock = f.select("symbol", "date", F.col("ret_1d").alias("y"))
    market_ = stock.groupBy("date").agg(F.avg("y").alias("m"))
    drv = ST.driver_returns(A.macro(spark, d).withColumnRenamed("series_id", "driver"))
    return stock, drv, market_


@query("X1_exposure_map", f"""WITH {EX_SQL}, a AS (SELECT symbol, driver, {_FIT} FROM j GROUP BY 1, 2 HAVING count(*) >= 120), rk AS (SELECT symbol, driver, rank() OVER (PARTITION BY symbol, driver ORDER BY y) + (count(*) OVER (PARTITION BY symbol, driver, y) - 1) / 2.0 AS ry,
   rank() OVER (PARTITION BY symbol, driver ORDER BY x) + (count(*) OVER (PARTITION BY symbol, driver, x) - 1) / 2.0 AS rx FROM j), c AS (SELECT symbol, driver, corr(ry, rx) AS s FROM rk GROUP BY 1, 2)
  SELECT symbol, driver, n_obs, {_FITC}, {R(_B2, 8)} AS beta_ex_mkt, {R(_T2, 4)} AS t_ex_mkt, {R('s', 6)} AS spearman FROM a JOIN c USING (symbol, driver)""")
def _(spark, d):
    e = ST.exposure_map(*exposure_inputs(spark, d), min_obs=120)
    return rounded(rounded(rounded(e, ["beta", "beta_ex_mkt"], 8), ["t_stat", "t_ex_mkt"], 4), ["r2", "spearman"], 6)


@query("X2_trailing_exposure", f"""WITH {EX_SQL}, ed AS (SELECT DISTINCT date FROM macro WHERE series_id = 'click' AND value > 120), jj AS (SELECT * FROM j WHERE driver = 'click'),
  a AS (SELECT ed.date, symbol, {_FIT} FROM ed JOIN jj ON jj.date > ed.date - 1095 AND jj.date <= ed.date GROUP BY 1, 2 HAVING count(*) >= 40), b AS (SELECT date, symbol, n_obs, {_B2} AS bx, {_T2} AS tx FROM a)
  SELECT date, symbol, CASE WHEN bx > 0 THEN 1 ELSE -1 END AS sign, {R('bx', 6)} AS beta_ex_mkt, {R('tx', 4)} AS t_ex_mkt, n_obs FROM b WHERE abs(tx) > 1.5""")
def _(spark, d):
    stock, drv, mkt = exposure_inputs(spark, d)
    ev = A.macro(spark, d).where("series_id = 'click' and value > 120").select("date").distinct()
    t = ST.trailing_exposure(stock, drv.where("driver = 'click'"), mkt, ev, 3, 40, 1.5)
    return rounded(rounded(t, ["beta_ex_mkt"]), ["t_ex_mkt"], 4)


@query("X3_shock_factor", f"""WITH {MACRO}, m AS (SELECT series_id AS driver, date, (v / lag(v) OVER (PARTITION BY series_id ORDER BY date) - 1) * 100 AS move FROM (SELECT *, CASE WHEN value > 0 THEN value END AS v FROM macro)),
  s AS (SELECT *, CASE WHEN abs(move) >= 200 THEN move END AS sh FROM m) SELECT driver, date, {R('coalesce(last_value(sh IGNORE NULLS) OVER (PARTITION BY driver ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)', 4)} AS factor FROM s""")
def _(spark, d):
    m = ST.driver_returns(A.macro(spark, d).withColumnRenamed("series_id", "driver")).select("driver", "date", (F.col("x") * 100).alias("move"))
    return ST.shock_factor(m, 200).select("driver", "date", r("factor", 4).alias("factor"))


_LEGS = f"""ed AS (SELECT DISTINCT date FROM macro WHERE series_id = 'click' AND value > 120), jj AS (SELECT * FROM j WHERE driver = 'click'), a AS (SELECT ed.date, symbol, {_FIT} FROM ed JOIN jj ON jj.date > ed.date - 1095 AND jj.date <= ed.date GROUP BY 1, 2 HAVING count(*) >= 40),
  ev AS (SELECT date, symbol, CASE WHEN {_B2} > 0 THEN 1 ELSE -1 END AS sign, {_T2} AS tx FROM a WHERE abs({_T2}) > 1.0)"""


@query("X3_shock_study_grid", f"""WITH {EX_SQL}, {_LEGS}, bx AS MATERIALIZED (SELECT symbol, date, close, row_number() OVER {_W} AS i FROM bars), bm AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) AS i, sum(CAST(close * 10000 AS BIGINT)) / count(*)::DOUBLE / 10000 AS bench FROM bars GROUP BY 1),
  d0 AS (SELECT ev.*, bx.i FROM ev ASOF JOIN bx ON ev.symbol = bx.symbol AND ev.date <= bx.date), dd AS (SELECT d0.symbol, d0.date, d0.sign, d0.tx, d0.i + 1 AS i, bx.date AS day0 FROM d0 JOIN bx ON bx.symbol = d0.symbol AND bx.i = d0.i + 1 WHERE bx.date - d0.date <= 15),
  pt AS (SELECT dd.symbol, dd.date, dd.sign, dd.tx, CAST(p.i - dd.i AS INTEGER) AS rel, p.close / q.close - 1 - (bp.bench / bq.bench - 1) AS car FROM dd JOIN bx p ON p.symbol = dd.symbol AND p.i BETWEEN dd.i AND dd.i + 5 JOIN bx q ON q.symbol = dd.symbol AND q.i = dd.i - 1
     JOIN bm b0 ON b0.date = dd.day0 JOIN bm bp ON bp.i = b0.i + (p.i - dd.i) JOIN bm bq ON bq.i = b0.i - 1), car AS (SELECT *, count(*) OVER (PARTITION BY symbol, date) AS bars FROM pt),
  pd AS (SELECT sign, min_t, rel, date, avg(car) AS m FROM (SELECT *, unnest([1.0, 1.5, 2.0]) AS min_t FROM car WHERE bars = 6) WHERE abs(tx) > min_t GROUP BY 1, 2, 3, 4), cl AS (SELECT sign, min_t, rel, 100 * avg(m) AS e FROM pd GROUP BY 1, 2, 3)
  SELECT sign, rel, count(*) AS cells, {R('greatest(avg((e > 0)::INT), 1 - avg((e > 0)::INT))')} AS stability, {R('avg(e)')} AS mean_effect FROM cl WHERE rel >= 1 GROUP BY 1, 2""")
def _(spark, d):
    """Legs by trailing exposure sign, event paths per leg, over a grid of exposure thresholds."""
    stock, drv, mkt = exposure_inputs(spark, d)
    ev = A.macro(spark, d).where("series_id = 'click' and value > 120").select("date").distinct()
    legs = ST.trailing_exposure(stock, drv.where("driver = 'click'"), mkt, ev, 3, 40, 1.0)
    b = closes(spark, d)
    p = ST.event_paths(legs, b, 0, 5, market(b), entry_lag=1)
    grid = p.withColumn("min_t", F.explode(F.array(*[F.lit(x) for x in (1.0, 1.5, 2.0)]))).where(F.abs("t_ex_mkt") > F.col("min_t"))
    cells = ST.date_level(ST.car_rows(grid, 0, ["sign", "min_t", "date"]), ["sign", "min_t"])
    return rounded(ST.sign_stability(cells.where("rel >= 1"), ["sign", "rel"], "mean_pct"), ["stability", "mean_effect"])


@query("R2_evaluate_events", f"""WITH {EV_SQL.replace("dd.i + 10", "dd.i + 21").replace("dd.i - 2 AND", "dd.i AND").replace("count(*) = 13", "count(*) = 22")
    .replace("SELECT article_id, symbol, date, topic AS label FROM news WHERE score > 0.2", "SELECT row_number() OVER () AS article_id, symbol, date, label FROM es WHERE label IN (SELECT label FROM es GROUP BY 1 HAVING count(*) >= 30)")
    .replace("ev AS (", "es AS MATERIALIZED (SELECT DISTINCT symbol, date + 2 AS date, CASE WHEN symbol = 1 AND score > 0.2 THEN 'rare' WHEN symbol % 5 = 0 THEN topic END AS label FROM news WHERE score > 0.2 AND (symbol = 1 OR symbol % 5 = 0)), ev AS (", 1)},
  h AS (SELECT label, rel, {_HT} FROM car WHERE rel IN (1, 5, 10, 21) GROUP BY 1, 2)
  SELECT 'events:' || label AS evaluation, rel AS horizon, unnest(['mean_pct', 'median_pct', 'hit_rate_pct', 't_stat']) AS statistic, unnest([mean_pct, median_pct, hit_rate_pct, t_stat]) AS value, n FROM h UNION ALL
  SELECT 'events:' || label, NULL, 'skipped', NULL, count(*) FROM es GROUP BY label HAVING label NOT IN (SELECT label FROM h)""")
def _(spark, d):
    """An event set of several labels, one of them too small, known two days after its dates."""
    from tidemark.operators import registry as RG
    n, s = A.news(spark, d).where("score > 0.2 AND (symbol = 1 OR symbol % 5 = 0)"), F.col("symbol")
    ev = RG.EventSet(n.select("symbol", "date", F.when(s == 1, "rare").otherwise(F.col("topic")).alias("label")).distinct(), "news", lag_days=2, min_events=30)
    b = closes(spark, d)
    return rounded(ST.evaluate_events(ev.frame, b, market(b), min_events=ev.min_events, lag_days=ev.lag_days), ["value"], 4)
