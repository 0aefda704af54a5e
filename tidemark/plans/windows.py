"""Window, feature and factor queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tidemark.functions import exprs as X
from tidemark.operators import factors as FA, features as FE
from tidemark.operators.relational import position_within
from tidemark.plans.base import query, r, rounded
from tidemark.plans.sqlbits import BARS, FACTS, HOLDINGS, INSIDER, MACRO, NEWS, R, SHORT
from tidemark.sources import adapters as A
from tidemark.sources.workspace import materialise

_W = "PARTITION BY symbol ORDER BY date"


def _ret_sql(k):
    return f"close / lag(close, {k}) OVER ({_W}) - 1"


@query("W1_returns", f"WITH {BARS} SELECT symbol, date, " + ", ".join(f"{R(_ret_sql(k), 9)} AS ret_{k}d" for k in (1, 21, 63, 252)) + " FROM bars")
def _(spark, d):
    return rounded(FE.returns(A.bars(spark, d).select("symbol", "date", "close")), [f"ret_{k}d" for k in (1, 21, 63, 252)], 9).drop("close")


@query("W2_momentum_12_1", f"WITH {BARS} SELECT symbol, date, {R(f'lag(close, 21) OVER ({_W}) / lag(close, 252) OVER ({_W}) - 1', 9)} AS mom_12_1 FROM bars")
def _(spark, d):
    return rounded(FE.momentum_skip(A.bars(spark, d).select("symbol", "date", "close")), ["mom_12_1"], 9).drop("close")


_T21 = f"({_W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)"
_PF = f"""r1 AS (SELECT *, {_ret_sql(1)} AS ret_1d, {_ret_sql(21)} AS ret_21d, {_ret_sql(63)} AS ret_63d, {_ret_sql(252)} AS ret_252d,
   lag(close, 21) OVER ({_W}) / lag(close, 252) OVER ({_W}) - 1 AS mom_12_1 FROM bars),
  pf AS (SELECT *, CASE WHEN count(ret_1d) OVER {_T21} >= 21 THEN stddev_samp(ret_1d) OVER {_T21} END * sqrt(252) AS vol_21d,
   CASE WHEN count(*) OVER {_T21} >= 21 THEN avg(close * volume) OVER {_T21} END AS dollar_vol_21d FROM r1)"""


@query("W3_vol_and_dollar_volume", f"WITH {BARS}, {_PF} SELECT symbol, date, {R('vol_21d')} AS vol_21d, {R('dollar_vol_21d', 4)} AS dollar_vol_21d FROM pf")
def _(spark, d):
    f = FE.price_features(A.bars(spark, d)).select("symbol", "date", r("vol_21d").alias("vol_21d"), r("dollar_vol_21d", 4).alias("dollar_vol_21d"))
    return f


@query("W4_trailing_liquidity", f"""WITH {BARS}, p AS (SELECT * FROM bars WHERE date >= DATE '1997-01-01' - 45),
  v AS (SELECT symbol, date, avg(close * volume) OVER {_T21} AS dv FROM p) SELECT symbol, date, {R('dv', 4)} AS dollar_vol FROM v WHERE date >= DATE '1997-01-01' AND dv >= 2500""")
def _(spark, d):
    return rounded(FE.liquid(A.bars(spark, d), 2500, "1997-01-01"), ["dollar_vol"], 4)


_JUMP = f"""j AS (SELECT symbol, max(abs(ln(close / prev))) AS m, min(close) AS min_close FROM
   (SELECT symbol, close, lag(close) OVER ({_W}) AS prev FROM bars) WHERE prev > 0 AND close > 0 GROUP BY 1 HAVING max(abs(ln(close / prev))) > 0.9)"""


@query("W5_price_jumps", f"WITH {BARS}, {_JUMP} SELECT symbol, {R('m')} AS max_abs_log_ret, min_close FROM j")
def _(spark, d):
    return rounded(FE.price_jumps(A.bars(spark, d), 0.9), ["max_abs_log_ret"])


@query("W5_clean_symbols", f"WITH {BARS}, {_JUMP} SELECT symbol, count(*) AS bars FROM bars WHERE symbol NOT IN (SELECT symbol FROM j) GROUP BY 1")
def _(spark, d):
    return FE.without_jumps(A.bars(spark, d), 0.9).groupBy("symbol").agg(F.count("*").alias("bars"))


@query("W6_lookback_padding", f"""WITH {BARS}, p AS (SELECT *, lag(close, 63) OVER ({_W}) AS c63 FROM bars WHERE date >= DATE '1999-06-01' - 450)
  SELECT symbol, date, {R('close / c63 - 1', 9)} AS ret_63d FROM p WHERE date >= DATE '1999-06-01'""")
def _(spark, d):
    go = lambda b: FE.returns(b, (63,))
    return FE.with_lookback(A.bars(spark, d), "1999-06-01", 450, go).select("symbol", "date", r("ret_63d", 9).alias("ret_63d"))


@query("W7_split_adjust", f"""WITH {BARS}, s AS (SELECT *, CASE WHEN volume > 80 THEN 2.0::DOUBLE WHEN volume < 1.5 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS f FROM bars),
  a AS (SELECT *, coalesce(product(f) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS g FROM s)
  SELECT symbol, date, close / g AS close, volume * g AS volume FROM a""")
def _(spark, d):
    v = F.col("volume")
    b = A.bars(spark, d).withColumn("split_factor", F.when(v > 80, 2.0).when(v < 1.5, 0.5))
    return FE.split_adjust(b).select("symbol", "date", "close", "volume")  # factors are powers of two: exact


@query("W8_zscore_by_date", f"""WITH {BARS}, {_PF} SELECT symbol, date, CASE WHEN ret_21d IS NULL THEN NULL WHEN coalesce(stddev_pop(ret_21d) OVER d, 0) < 1e-12 THEN 0
   ELSE {R('(ret_21d - avg(ret_21d) OVER d) / stddev_pop(ret_21d) OVER d')} END AS z FROM pf WINDOW d AS (PARTITION BY date)""")
def _(spark, d):
    f = FE.returns(A.bars(spark, d).select("symbol", "date", "close"), (21,))
    return FE.zscore_by(f.select("symbol", "date", F.col("ret_21d").alias("z")), "date", ["z"]).select("symbol", "date", r("z").alias("z"))


@query("W9_change_levels", f"""WITH {BARS}, s AS (SELECT symbol, date, floor(close / 10) AS v FROM bars), c AS (SELECT *, CASE WHEN v = lag(v) OVER ({_W}) THEN 0 ELSE 1 END AS chg FROM s),
  l AS (SELECT *, sum(chg) OVER ({_W}) AS level FROM c), f AS (SELECT symbol, level, any_value(v) AS v FROM l GROUP BY 1, 2),
  p AS (SELECT symbol, level, lag(v) OVER (PARTITION BY symbol ORDER BY level) AS prior_value FROM f)
  SELECT symbol, date, CAST(level AS BIGINT) AS level, CAST(prior_value AS DOUBLE) AS prior_value FROM l JOIN p USING (symbol, level)""")
def _(spark, d):
    b = A.bars(spark, d).select("symbol", "date", F.floor(F.col("close") / 10).alias("v"))
    return FE.change_levels(b, "v").select("symbol", "date", "level", F.col("prior_value").cast("double").alias("prior_value"))


@query("W10_rank_within_date", f"""WITH {BARS} SELECT symbol, date, close, row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) AS rank FROM bars""")
def _(spark, d):
    return position_within(A.bars(spark, d).select("symbol", "date", "close"), ["date"], "close", "symbol", "rank", descending=True).drop("rank_of")


_DD = f"""e AS (SELECT symbol, date, close / first_value(close) OVER ({_W}) AS equity FROM bars), pk AS (SELECT *, max(equity) OVER ({_W}) AS peak FROM e),
  dd AS (SELECT *, equity / peak - 1 AS drawdown FROM pk)"""


@query("W11_equity_and_drawdown", f"WITH {BARS}, {_DD} SELECT symbol, date, {R('equity', 9)} AS equity, {R('peak', 9)} AS peak, {R('drawdown', 9)} AS drawdown FROM dd")
def _(spark, d):
    return rounded(FE.drawdowns(A.bars(spark, d).select("symbol", "date", "close")).drop("close"), ["equity", "peak", "drawdown"], 9)


@query("W12_drawdown_episodes", f"""WITH {BARS}, {_DD}, g AS (SELECT *, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER ({_W}) AS g FROM dd),
  ep AS (SELECT symbol, g, min(date) AS peak_date, arg_min(date, row(drawdown, date)) AS valley_date, min(drawdown) AS depth, max(date) AS last FROM g GROUP BY 1, 2),
  n AS (SELECT *, lead(peak_date) OVER (PARTITION BY symbol ORDER BY g) AS rec FROM ep)
  SELECT symbol, peak_date, valley_date, CAST(rec AS VARCHAR) AS recovery_date, {R('depth * 100')} AS depth_pct, valley_date - peak_date AS days_to_valley,
   CAST(rec - valley_date AS DOUBLE) AS days_to_recovery, coalesce(rec, last) - peak_date AS total_days, rec IS NOT NULL AS recovered FROM n WHERE depth < 0""")
def _(spark, d):
    e = FE.drawdown_episodes(FE.drawdowns(A.bars(spark, d)))
    e = e.withColumn("recovery_date", F.col("recovery_date").cast("string")).withColumn("days_to_recovery", F.col("days_to_recovery").cast("double"))
    return rounded(e, ["depth_pct"]).withColumn("days_to_valley", F.col("days_to_valley").cast("bigint")).withColumn("total_days", F.col("total_days").cast("bigint"))


_T63 = f"({_W} ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"


@query("W13_rolling_metrics", f"""WITH {BARS}, x AS (SELECT symbol, date, {_ret_sql(1)} AS r FROM bars), m AS (SELECT symbol, date, count(r) OVER {_T63} AS n, avg(r) OVER {_T63} AS mu,
   stddev_samp(r) OVER {_T63} AS sd, sqrt(avg(CASE WHEN r < 0 THEN r * r END) OVER {_T63}) AS dn FROM x)
  SELECT symbol, date, CASE WHEN n >= 63 AND sd > 1e-12 THEN {R('mu / sd * sqrt(252)')} END AS rolling_sharpe, CASE WHEN n >= 63 AND dn > 1e-12 THEN {R('mu / dn * sqrt(252)')} END AS rolling_sortino,
   CASE WHEN n >= 63 THEN {R('sd * sqrt(252) * 100')} END AS rolling_vol_pct FROM m""")
def _(spark, d):
    f = FE.rolling_metrics(FE.returns(A.bars(spark, d).select("symbol", "date", "close"), (1,)))
    return rounded(f.select("symbol", "date", "rolling_sharpe", "rolling_sortino", "rolling_vol_pct"), ["rolling_sharpe", "rolling_sortino", "rolling_vol_pct"])


@query("W14_threshold_crossings", f"""WITH {BARS}, x AS (SELECT symbol, date, close, lag(close) OVER ({_W}) AS p FROM bars)
  SELECT symbol, date, close, close > 80 AS up FROM x WHERE (close > 80 AND NOT coalesce(p > 80, false)) OR (close < 60 AND NOT coalesce(p < 60, false))""")
def _(spark, d):
    w, c = FE.by_symbol(), F.col("close")
    b = A.bars(spark, d).select("symbol", "date", "close")
    return (b.withColumn("up", FE.crossed_above(c, 80, w)).withColumn("_dn", FE.crossed_below(c, 60, w)).where("up or _dn").drop("_dn"))


@query("W15_price_move_events", f"""WITH {BARS}, x AS (SELECT symbol, date, (close / lag(close, 5) OVER ({_W}) - 1) * 100 AS m FROM bars) SELECT symbol, date, {R('m', 2)} AS move_pct FROM x WHERE m <= -25""")
def _(spark, d):
    m = FE.returns(A.bars(spark, d).select("symbol", "date", "close"), (5,)).select("symbol", "date", (F.col("ret_5d") * 100).alias("m"))
    return m.where("m <= -25").select("symbol", "date", r("m", 2).alias("move_pct"))


@query("W16_decluster", f"""WITH RECURSIVE {BARS}, e AS (SELECT symbol, date FROM (SELECT symbol, date, close / lag(close, 5) OVER ({_W}) - 1 AS m FROM bars) WHERE m >= 0.1),
  nx AS (SELECT a.symbol, a.date, min(b.date) AS nd FROM e a LEFT JOIN e b ON a.symbol = b.symbol AND a.date + 30 <= b.date GROUP BY 1, 2),
  k AS (SELECT symbol, min(date) AS date FROM e GROUP BY 1 UNION ALL SELECT nx.symbol, nx.nd FROM k JOIN nx ON k.symbol = nx.symbol AND k.date = nx.date WHERE nx.nd IS NOT NULL)
  SELECT symbol, date FROM k""")
def _(spark, d):
    m = FE.returns(A.bars(spark, d).select("symbol", "date", "close"), (5,))
    return FE.decluster(m.where("ret_5d >= 0.1"), 30)


_LABEL = """CASE WHEN s > .5 THEN 'strong_buy' WHEN s > .1 THEN 'buy' WHEN s > -.1 THEN 'neutral' WHEN s > -.5 THEN 'sell' WHEN s > -1.01 THEN 'strong_sell' END"""


def _labelled(spark, d):
    s = X.clip(F.col("ret_21d") * 3, -1, 1)
    f = FE.returns(A.bars(spark, d).select("symbol", "date", "close"), (21,)).withColumn("score", s)
    return f.withColumn("rating_label", X.rating_bin("score"))


@query("W17_rating_changes", f"""WITH {BARS}, x AS (SELECT symbol, date, greatest(-1, least(1, ({_ret_sql(21)}) * 3)) AS s, ({_ret_sql(21)}) IS NULL AS nul FROM bars),
  l AS (SELECT symbol, date, CASE WHEN NOT nul THEN s END AS s FROM x), m AS (SELECT *, {_LABEL} AS lab FROM l),
  o AS (SELECT *, CASE lab WHEN 'strong_sell' THEN 0 WHEN 'sell' THEN 1 WHEN 'neutral' THEN 2 WHEN 'buy' THEN 3 WHEN 'strong_buy' THEN 4 END AS o FROM m),
  p AS (SELECT *, lag(lab) OVER ({_W}) AS pl, lag(s) OVER ({_W}) AS ps, o - lag(o) OVER ({_W}) AS st FROM o)
  SELECT symbol, date, pl AS from_label, lab AS to_label, {R('ps', 3)} AS from_score, {R('s', 3)} AS to_score, abs(st) AS step, CASE WHEN st > 0 THEN 'upgrade' ELSE 'downgrade' END AS direction
  FROM p WHERE st <> 0 AND abs(st) >= 2""")
def _(spark, d):
    return rounded(FE.label_changes(_labelled(spark, d), min_step=2), ["from_score", "to_score"], 3)


@query("W18_snapshot_label_diff", f"""WITH {HOLDINGS}, t AS (SELECT ticker, snapshot, CASE WHEN sum(market_value) > 100000 THEN 'big' WHEN sum(market_value) > 40000 THEN 'mid' ELSE 'small' END AS lab FROM holdings GROUP BY 1, 2),
  s AS (SELECT DISTINCT snapshot FROM t ORDER BY 1 DESC LIMIT 2), a AS (SELECT * FROM t WHERE snapshot = (SELECT min(snapshot) FROM s)), b AS (SELECT * FROM t WHERE snapshot = (SELECT max(snapshot) FROM s))
  SELECT ticker, a.lab AS from_label, b.lab AS to_label FROM a JOIN b USING (ticker) WHERE a.lab <> b.lab""")
def _(spark, d):
    mv = F.sum("market_value")
    t = A.holdings(spark, d).groupBy("ticker", "snapshot").agg(F.when(mv > 100000, "big").when(mv > 40000, "mid").otherwise("small").alias("lab"))
    return FE.snapshot_label_diff(t, "ticker", "snapshot", "lab")


FWD = """bm AS (SELECT date, sum(CAST(close * 10000 AS BIGINT)) / count(*)::DOUBLE / 10000 AS bench FROM bars GROUP BY 1),
  us AS (SELECT symbol, date, close, last_value(bench IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bench
     FROM (SELECT symbol, date, close, count(*) OVER (PARTITION BY symbol) AS n FROM bars) LEFT JOIN bm USING (date) WHERE n >= 12)"""


def fwd_sql(h):
    return f"""lead(close, {h}) OVER ({_W}) / close - 1 - (lead(bench, {h}) OVER ({_W}) / bench - 1) AS fwd_{h}d"""


def market(bars):
    """Equal-weight price level per day, exact integer sum."""
    return bars.groupBy("date").agg((F.sum(F.round(F.col("close") * 10000).cast("bigint")) / F.count("*") / 10000).alias("bench"))


@query("W19_forward_excess_returns", f"""WITH {BARS}, {NEWS}, {FWD}, fw AS (SELECT symbol, date AS entry_date, {fwd_sql(1)}, {fwd_sql(5)}, {fwd_sql(10)} FROM us),
  j AS (SELECT n.article_id, n.symbol, n.date, fw.* EXCLUDE (symbol) FROM news n ASOF LEFT JOIN fw ON n.symbol = fw.symbol AND n.date < fw.entry_date WHERE n.symbol IN (SELECT symbol FROM us))
  SELECT article_id, symbol, date, CAST(entry_date AS VARCHAR) AS entry_date, {R('fwd_1d')} AS fwd_1d, {R('fwd_5d')} AS fwd_5d, {R('fwd_10d')} AS fwd_10d FROM j""")
def _(spark, d):
    b = A.bars(spark, d)
    p = FE.return_panel(A.news(spark, d).select("article_id", "symbol", "date"), b, market(b), [1, 5, 10])
    return rounded(p.withColumn("entry_date", F.col("entry_date").cast("string")), ["fwd_1d", "fwd_5d", "fwd_10d"])


@query("W20_period_end_dates", """SELECT 'week' AS freq, max(dt) AS date FROM (SELECT CAST(l_shipdate AS DATE) AS dt FROM lineitem) GROUP BY date_trunc('week', dt) UNION ALL
  SELECT 'month', max(dt) FROM (SELECT CAST(l_shipdate AS DATE) AS dt FROM lineitem) GROUP BY date_trunc('month', dt) UNION ALL
  SELECT 'quarter', max(dt) FROM (SELECT CAST(l_shipdate AS DATE) AS dt FROM lineitem) GROUP BY date_trunc('quarter', dt)""")
def _(spark, d):
    days = A.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    f = lambda q: FE.period_last_dates(days, q).select(F.lit(q).alias("freq"), "date")
    return f("week").unionByName(f("month")).unionByName(f("quarter"))


@query("W21_carry_targets", f"""WITH {BARS}, t AS (SELECT symbol, date, CASE WHEN day(date) <= 3 THEN round(volume / 100, 6) END AS w FROM bars),
  f AS (SELECT symbol, date, last_value(w IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS w FROM t)
  SELECT symbol, date, coalesce(lag(w) OVER ({_W}), 0) AS held FROM f""")
def _(spark, d):
    b = A.bars(spark, d).select("symbol", "date", "volume")
    t = b.where(F.dayofmonth("date") <= 3).select("symbol", "date", F.round(F.col("volume") / 100, 6).alias("weight"))
    return FE.carry_targets(b, t).select("symbol", "date", "held")


@query("W22_regimes", f"""WITH {BARS}, x AS (SELECT symbol, date, close, {_ret_sql(1)} AS r FROM bars), m AS (SELECT *, CASE WHEN count(*) OVER a >= 200 THEN avg(close) OVER a END AS sma,
   CASE WHEN count(r) OVER v >= 21 THEN stddev_samp(r) OVER v END AS vol FROM x WINDOW a AS ({_W} ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), v AS ({_W} ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
  md AS (SELECT symbol, quantile_cont(vol, 0.5) AS med FROM m GROUP BY 1)
  SELECT symbol, count(*) FILTER (close >= sma) AS bull, count(*) FILTER (close < sma) AS bear, count(*) FILTER (vol > med) AS high_vol, count(*) FILTER (vol <= med) AS low_vol FROM m JOIN md USING (symbol) GROUP BY 1""")
def _(spark, d):
    g = FE.regimes(A.bars(spark, d).select("symbol", "date", "close"))
    return g.groupBy("symbol").agg(*[F.count_if(F.col(c) == v).alias(v) for c, v in (("trend", "bull"), ("trend", "bear"), ("vol_regime", "high_vol"), ("vol_regime", "low_vol"))])


@query("W23_confirmed_pivots", f"""WITH {BARS}, x AS (SELECT symbol, date, high, list(high) OVER f AS a FROM bars WINDOW f AS ({_W} ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)),
  p AS (SELECT symbol, date, CASE WHEN len(a) = 8 AND high = list_max(a) AND len(list_filter(a, lambda v: v = high)) = 1 THEN high END AS pv FROM x),
  c AS (SELECT symbol, date, lag(pv, 3) OVER ({_W}) AS pivot_high FROM p) SELECT * FROM c WHERE pivot_high IS NOT NULL""")
def _(spark, d):
    return FE.pivot_confirmed(A.bars(spark, d).select("symbol", "date", "high"), "high", 4, 3, True, "pivot_high").where("pivot_high is not null").drop("high")


@query("W24_percent_rank_prior", f"""WITH {BARS}, x AS (SELECT symbol, date, close, list(close) OVER ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS a FROM bars)
  SELECT symbol, date, CASE WHEN len(a) = 20 THEN len(list_filter(a, lambda v: v <= close)) * 100.0::DOUBLE / 20 END AS pct FROM x""")
def _(spark, d):
    return A.bars(spark, d).select("symbol", "date", FE.percent_rank_prior(F.col("close"), 20, FE.by_symbol()).alias("pct"))


@query("W25_vol_estimators", f"""WITH {BARS}, bm AS (SELECT date, sum(CAST(close * 10000 AS BIGINT)) / count(*)::DOUBLE / 10000 AS lv FROM bars GROUP BY 1),
  ov AS (SELECT date, CASE WHEN count(*) OVER w >= 7 THEN lv / avg(lv) OVER w END AS overlay FROM bm WINDOW w AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
  x AS (SELECT symbol, date, ln(close / lag(close) OVER ({_W})) AS lr, ln(open / lag(close) OVER ({_W})) AS o, ln(close / open) AS c, ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open)) AS rs FROM bars),
  m AS (SELECT symbol, date, CASE WHEN count(lr) OVER w >= 30 THEN stddev_samp(lr) OVER w END * sqrt(252) AS cc, CASE WHEN count(o) OVER w >= 30 THEN
    sqrt(greatest(var_samp(o) OVER w + (0.34 / (1.34 + 31.0 / 29.0))::DOUBLE * var_samp(c) OVER w + (1 - 0.34 / (1.34 + 31.0 / 29.0))::DOUBLE * avg(rs) OVER w, 0) * 252) END AS yz FROM x WINDOW w AS ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
  SELECT symbol, date, {R('cc')} AS cc_vol, {R('yz')} AS yz_vol, {R('cc * overlay')} AS vix_vol FROM m JOIN ov USING (date)""")
def _(spark, d):
    b = A.bars(spark, d)
    out = FE.overlay_vol(FE.yang_zhang(b, 30), market(b).withColumnRenamed("bench", "level"), 30)
    return rounded(out.select("symbol", "date", "cc_vol", "yz_vol", "vix_vol"), ["cc_vol", "yz_vol", "vix_vol"])


@query("W26_event_window_stats", f"""WITH {BARS}, {NEWS}, b AS (SELECT symbol, date AS anchor_date, coalesce(lag(close) OVER ({_W}), close) AS base, close, """ + ", ".join(
    f"lead(close, {h}) OVER ({_W}) AS c{h}" for h in (1, 3, 5, 10)) + f""" FROM bars)
  SELECT n.article_id, CAST(anchor_date AS VARCHAR) AS anchor_date, {R('close / base - 1')} AS day0, """ + ", ".join(f"{R(f'c{h} / base - 1')} AS cum_{h}d" for h in (1, 3, 5, 10)) +
  " FROM (SELECT * FROM news WHERE topic = 'purchase') n ASOF LEFT JOIN b ON n.symbol = b.symbol AND n.date <= b.anchor_date")
def _(spark, d):
    ev = A.news(spark, d).where("topic = 'purchase'").select("article_id", "symbol", "date")
    out = FE.event_window_stats(ev, A.bars(spark, d)).drop("symbol", "date").withColumn("anchor_date", F.col("anchor_date").cast("string"))
    return rounded(out, ["day0", "cum_1d", "cum_3d", "cum_5d", "cum_10d"])


# --- feature matrix and factors --------------------------------------------------------------

# fixed values: default factor weights
WEIGHTS = {"momentum": 1.0, "value": 0.0, "quality": 0.0, "low_vol": 1.0, "growth": 1.0, "short_pressure": 1.0, "insider_flow": 0.0, "sentiment": 0.0}

_FUND = " ".join(f"ASOF LEFT JOIN (SELECT symbol, filed, value AS {m} FROM lp WHERE metric = '{m}') f_{m} ON pf.symbol = f_{m}.symbol AND pf.date >= f_{m}.filed" for m in A.METRICS)
FM_SQL = f"""{BARS}, {_PF}, {FACTS}, {SHORT}, {INSIDER}, {NEWS}, {MACRO},
  lp AS (SELECT symbol, filed, metric, arg_max(value, row(period_end, accn)) AS value FROM facts GROUP BY 1, 2, 3),
  si AS (SELECT symbol, settlement_date + 7 AS public_date, max(days_to_cover) AS si_days_to_cover, max(shares_short) AS si_shares_short FROM short_interest GROUP BY 1, 2),
  ins AS (SELECT p.symbol, p.date, CAST(sum(i.shares) AS DOUBLE) AS insider_net_90d FROM pf p JOIN (SELECT symbol, date + 3 AS pub, shares FROM insider) i
     ON p.symbol = i.symbol AND i.pub <= p.date AND i.pub > p.date - 90 GROUP BY 1, 2),
  nw AS (SELECT p.symbol, p.date, avg(n.score) AS news_score_21d, count(n.score) AS news_count_21d FROM pf p JOIN news n
     ON p.symbol = n.symbol AND n.date <= p.date AND n.date > p.date - 21 GROUP BY 1, 2),
  fm AS (SELECT pf.*, {", ".join(f"f_{m}.{m} AS fund_{m}" for m in A.METRICS)}, si.si_days_to_cover, si.si_shares_short, ins.insider_net_90d, nw.news_score_21d,
     coalesce(nw.news_count_21d, 0) AS news_count_21d, c.value AS click FROM pf {_FUND} ASOF LEFT JOIN si ON pf.symbol = si.symbol AND pf.date >= si.public_date
     ASOF LEFT JOIN (SELECT * FROM macro WHERE series_id = 'click') c ON pf.date >= c.date
     LEFT JOIN ins ON pf.symbol = ins.symbol AND pf.date = ins.date LEFT JOIN nw ON pf.symbol = nw.symbol AND pf.date = nw.date)"""
_FM_COLS = ["ret_1d", "ret_21d", "ret_63d", "ret_252d", "mom_12_1", "vol_21d", *[f"fund_{m}" for m in A.METRICS], "si_days_to_cover", "si_shares_short",
            "insider_net_90d", "news_score_21d", "click"]


def feature_matrix(spark, d, macro=True):
    return FA.feature_matrix(A.bars(spark, d), A.facts(spark, d), A.METRICS, None, A.short_interest(spark, d), A.insider(spark, d), A.news(spark, d),
                             A.macro(spark, d) if macro else None, ["click"])


@query("P1_feature_matrix", f"WITH {FM_SQL} SELECT symbol, date, close, volume, news_count_21d, {R('dollar_vol_21d', 4)} AS dollar_vol_21d, " +
       ", ".join(f"{R(c)} AS {c}" for c in _FM_COLS) + " FROM fm")
def _(spark, d):
    fm = feature_matrix(spark, d)
    return fm.select("symbol", "date", "close", "volume", "news_count_21d", r("dollar_vol_21d", 4).alias("dollar_vol_21d"), *[r(c).alias(c) for c in _FM_COLS])


_LW = "(PARTITION BY symbol ORDER BY date)"
RAW_SQL = f"""{FM_SQL}, g1 AS (SELECT *, CASE WHEN fund_revenue = lag(fund_revenue) OVER {_LW} THEN 0 ELSE 1 END AS chg FROM fm),
  g2 AS (SELECT *, sum(chg) OVER {_LW} AS lvl FROM g1), g3 AS (SELECT symbol, lvl, max(fund_revenue) AS v FROM g2 GROUP BY 1, 2),
  g4 AS (SELECT symbol, lvl, lag(v) OVER (PARTITION BY symbol ORDER BY lvl) AS prior FROM g3),
  raw AS (SELECT symbol, date, close, coalesce(mom_12_1, ret_63d) AS momentum, CASE WHEN close > 0 THEN fund_eps / close END AS value,
    (CASE WHEN fund_total_assets > 0 THEN fund_net_income / fund_total_assets END + CASE WHEN fund_revenue > 0 THEN fund_gross_profit / fund_revenue END) / 2 AS quality,
    vol_21d AS low_vol, CASE WHEN prior > 0 THEN (fund_revenue - prior) / abs(prior) END AS growth, -si_days_to_cover AS short_pressure,
    insider_net_90d AS insider_flow, news_score_21d AS sentiment FROM g2 JOIN g4 USING (symbol, lvl))"""


@query("P2_raw_factors", f"WITH {RAW_SQL} SELECT symbol, date, " + ", ".join(f"{R(c)} AS {c}" for c in FA.FACTORS) + " FROM raw")
def _(spark, d):
    raw = FA.raw_factors(feature_matrix(spark, d, macro=False))
    return raw.select("symbol", "date", *[r(c).alias(c) for c in FA.FACTORS])


_Z = lambda c: f"CASE WHEN {c} IS NULL THEN NULL WHEN coalesce(stddev_pop({c}) OVER d, 0) < 1e-12 THEN 0 ELSE ({c} - avg({c}) OVER d) / stddev_pop({c}) OVER d END AS {c}"
_USED = [c for c, v in WEIGHTS.items() if v]
PANEL_SQL = f"""{RAW_SQL}, z AS (SELECT symbol, date, {", ".join(_Z(c) for c in FA.FACTORS)} FROM raw WINDOW d AS (PARTITION BY date)),
  panel AS (SELECT *, ({" + ".join(f"coalesce({c}, 0)" for c in _USED)}) / nullif({" + ".join(f"({c} IS NOT NULL)::INT" for c in _USED)}, 0) AS composite FROM z)"""


def panel(spark, d, factors=tuple(FA.FACTORS)):
    """z-scores and composite; ``factors``: those that the caller reads, the others are not worked out."""
    raw = FA.raw_factors(feature_matrix(spark, d, macro=False)).select("symbol", "date", *factors)
    # z-scores and ranks read the factors several times: write them once rather than redo every join
    return FA.signal_panel(materialise(raw, "factors"), WEIGHTS)


@query("P3_signal_panel", f"WITH {PANEL_SQL} SELECT symbol, date, {', '.join(f'{R(c, 5)} AS {c}' for c in [*FA.FACTORS, 'composite'])} FROM panel")
def _(spark, d):
    return panel(spark, d).select("symbol", "date", *[r(c, 5).alias(c) for c in [*FA.FACTORS, "composite"]])


@query("P3_rank_symbols", f"""WITH {PANEL_SQL} SELECT symbol, date, round(composite, 5) + 0.0::DOUBLE AS composite, row_number() OVER (PARTITION BY date ORDER BY round(composite, 8) DESC, symbol) AS rank
  FROM panel WHERE composite IS NOT NULL""")
def _(spark, d):
    # positions read the scored panel three times
    p = materialise(panel(spark, d, [c for c in FA.FACTORS if WEIGHTS[c]]).select("symbol", "date", "composite", F.round("composite", 8).alias("c")), "composites")
    return position_within(p, ["date"], "c", "symbol", "rank", descending=True).select("symbol", "date", r("composite", 5).alias("composite"), "rank")


@query("P4_single_factor", f"WITH {PANEL_SQL} SELECT symbol, date, {R('momentum', 5)} AS value FROM panel WHERE momentum IS NOT NULL")
def _(spark, d):
    return panel(spark, d, ["momentum"]).where("momentum is not null").select("symbol", "date", r("momentum", 5).alias("value"))
