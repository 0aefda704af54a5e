"""Indicator, vote and rating queries.  The SQL twin smooths with a recursive query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import technical as TE
from tidemark.plans.base import query, r
from tidemark.plans.sqlbits import BARS, R
from tidemark.sources import adapters as A

_W = "(PARTITION BY symbol ORDER BY date)"


def _t(n):
    return f"(PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _roll(f, x, n):
    return f"CASE WHEN count({x}) OVER {_t(n)} >= {n} THEN {f}({x}) OVER {_t(n)} END"


def _mid(n):
    return f"(({_roll('max', 'high', n)}) + ({_roll('min', 'low', n)})) / 2"


def _pos(x, lo, hi, n):
    return f"100 * ({x} - ({_roll('min', lo, n)})) / nullif(({_roll('max', hi, n)}) - ({_roll('min', lo, n)}), 0)"


def _wma(x, n):
    return "(" + " + ".join(f"{n - k} * lag({x}, {k}) OVER {_W}" for k in range(n)) + f") / {n * (n + 1) // 2}.0::DOUBLE"


_EMAS = {**{f"ema{n}": n for n in TE.MA_LENGTHS}, "e12": 12, "e26": 26, "ema13": 13, "e9": 9, "e21": 21}
_RMAS = {"r_up": "up", "r_dn": "dn", "atr": "tr", "r_p": "pdm", "r_m": "mdm"}
_step = lambda x, prev, a: f"CASE WHEN {prev} IS NULL THEN {x} WHEN {x} IS NULL THEN {prev} ELSE {x} * {a} + {prev} * (1 - {a}) END"
# one recursion over the bars of a symbol carries every smoothed value
IND_SQL = f"""{BARS}, b0 AS MATERIALIZED (SELECT *, row_number() OVER {_W} AS i, lag(close) OVER {_W} AS pc, lag(high) OVER {_W} AS ph, lag(low) OVER {_W} AS pl FROM bars),
  mv AS MATERIALIZED (SELECT *, CASE WHEN i > 1 THEN greatest(close - pc, 0) END AS up, CASE WHEN i > 1 THEN greatest(pc - close, 0) END AS dn, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
    CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm FROM b0),
  rec AS (SELECT symbol, i, {", ".join(f"close AS {e}" for e in _EMAS)}, {", ".join(f"CAST({c} AS DOUBLE) AS {e}" for e, c in _RMAS.items())}, tr AS atr10 FROM mv WHERE i = 1
    UNION ALL SELECT m.symbol, m.i, {", ".join(f"m.close * (2.0::DOUBLE / {n + 1}) + rec.{e} * (1 - 2.0::DOUBLE / {n + 1})" for e, n in _EMAS.items())},
    {", ".join(_step(f"m.{c}", f"rec.{e}", "(1.0::DOUBLE / 14)") for e, c in _RMAS.items())}, {_step("m.tr", "rec.atr10", "(1.0::DOUBLE / 10)")} FROM rec JOIN mv m ON m.symbol = rec.symbol AND m.i = rec.i + 1),
  i1 AS MATERIALIZED (SELECT mv.*, {", ".join(f"CASE WHEN mv.i >= {n} THEN {e} END AS {e}" for e, n in _EMAS.items() if e not in ("e9", "e21"))}, e9, e21, CASE WHEN mv.i >= 15 THEN r_up END AS r_up, CASE WHEN mv.i >= 15 THEN r_dn END AS r_dn,
    CASE WHEN mv.i >= 14 THEN atr END AS atr14, CASE WHEN mv.i >= 14 THEN 100 * r_p / nullif(atr, 0) END AS plus_di, CASE WHEN mv.i >= 14 THEN 100 * r_m / nullif(atr, 0) END AS minus_di,
    CASE WHEN mv.i >= 26 THEN e12 - e26 END AS macd, CASE WHEN mv.i >= 10 THEN atr10 END AS atr10 FROM mv JOIN rec USING (symbol, i)),
  i2 AS MATERIALIZED (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx, CASE WHEN r_dn = 0 AND r_up > 0 THEN 100 WHEN r_dn <> 0 THEN 100 - 100 / (1 + r_up / r_dn) END AS rsi14 FROM i1),
  rec2 AS (SELECT symbol, i, macd AS sg, dx AS ad FROM i2 WHERE i = 1 UNION ALL SELECT m.symbol, m.i, {_step("m.macd", "rec2.sg", "0.2::DOUBLE")}, {_step("m.dx", "rec2.ad", "(1.0::DOUBLE / 14)")}
    FROM rec2 JOIN i2 m ON m.symbol = rec2.symbol AND m.i = rec2.i + 1),
  i3 AS (SELECT i2.*, CASE WHEN i2.i >= 34 THEN sg END AS macd_signal, CASE WHEN count(dx) OVER (PARTITION BY symbol ORDER BY i) >= 14 THEN ad END AS adx14, (high + low + close) / 3 AS tp,
    2 * (CASE WHEN i2.i >= 4 THEN {_wma('close', 4)} END) - {_wma('close', 9)} AS hin, {_pos('close', 'low', 'high', 14)} AS st, {_pos('rsi14', 'rsi14', 'rsi14', 14)} AS sr,
    close - least(low, coalesce(pc, low)) AS bp, greatest(high, coalesce(pc, high)) - least(low, coalesce(pc, low)) AS utr, list((high + low + close) / 3) OVER {_t(20)} AS tps FROM i2 JOIN rec2 USING (symbol, i)),
  i4 AS (SELECT *, {", ".join(f"{_roll('avg', 'close', n)} AS sma{n}" for n in TE.MA_LENGTHS)}, {_wma('hin', 3)} AS hull9, CASE WHEN i >= 20 THEN sum(close * volume) OVER {_t(20)} / sum(volume) OVER {_t(20)} END AS vwma20,
    {_mid(9)} AS ich_conv, {_mid(26)} AS ich_base, {_mid(52)} AS ich_lead2, {_roll('avg', 'st', 3)} AS stoch_k, CASE WHEN i >= 20 THEN (tp - list_avg(tps)) / nullif(0.015 * list_avg(list_transform(tps, lambda v: abs(v - list_avg(tps)))), 0) END AS cci20,
    {_roll('avg', '(high + low) / 2', 5)} - {_roll('avg', '(high + low) / 2', 34)} AS ao, close - lag(close, 10) OVER {_W} AS mom10, st - 100 AS willr14, high - ema13 AS bull_power, low - ema13 AS bear_power, {_roll('avg', 'sr', 3)} AS srsi_k,
    100 * (4 * ({_roll('sum', 'bp', 7)}) / nullif({_roll('sum', 'utr', 7)}, 0) + 2 * ({_roll('sum', 'bp', 14)}) / nullif({_roll('sum', 'utr', 14)}, 0) + ({_roll('sum', 'bp', 28)}) / nullif({_roll('sum', 'utr', 28)}, 0)) / 7 AS uo FROM i3),
  ind AS MATERIALIZED (SELECT *, (ich_conv + ich_base) / 2 AS ich_lead1, {_roll('avg', 'stoch_k', 3)} AS stoch_d, {_roll('avg', 'srsi_k', 3)} AS srsi_d FROM i4)"""


_OHLC = ["symbol", "date", "high", "low", "close"]


def _ind_query(name, cols, build, need=_OHLC, n=5):
    @query(name, f"WITH RECURSIVE {IND_SQL} SELECT symbol, date, {', '.join(f'{R(c, n)} AS {c}' for c in cols)} FROM ind")
    def _(spark, d):
        return build(A.bars(spark, d).select(*need)).select("symbol", "date", *[r(c, n).alias(c) for c in cols])


_C = ["symbol", "date", "close"]
_ind_query("T1_sma", [f"sma{n}" for n in TE.MA_LENGTHS], TE.with_sma, _C)
_ind_query("T2_ema", [f"ema{n}" for n in TE.MA_LENGTHS], lambda b: TE.smooth(b, TE.EMA_SPECS), _C)
_ind_query("T3_wilder_smoothing", ["atr14"], lambda b: TE.smooth(b.select("symbol", "date", TE.true_range().alias("_tr")), TE.ATR_SPECS))
_ind_query("T4_hull", ["hull9"], TE.with_hull, _C)
# volumes are whole numbers, so means often end in an exact decimal tie: both sides are nudged off it
@query("T5_vwma", f"WITH {BARS} SELECT symbol, date, {R(f'CASE WHEN count(*) OVER {_t(20)} >= 20 THEN sum(close * volume) OVER {_t(20)} / sum(volume) OVER {_t(20)} END + 1e-10')} AS vwma20 FROM bars")
def _(spark, d):
    return TE.with_vwma(A.bars(spark, d).select(*_C, "volume")).select("symbol", "date", r(F.col("vwma20") + 1e-10).alias("vwma20"))


_ind_query("T6_ichimoku", ["ich_conv", "ich_base", "ich_lead1", "ich_lead2"], TE.with_ichimoku, n=8)
_ind_query("T7_rsi", ["rsi14"], lambda b: TE.with_rsi(TE.smooth(TE.movements(b).select("symbol", "date", "_up", "_dn"), TE.RSI_SPECS)))
_ind_query("T8_stochastic", ["stoch_k", "stoch_d"], TE.with_stochastic)
_ind_query("T9_cci", ["cci20"], TE.with_cci, n=4)
_ind_query("T10_adx", ["adx14", "plus_di", "minus_di"], lambda b: TE.with_di(TE.smooth(TE.movements(b).select("symbol", "date", "_tr", "_pdm", "_mdm"), TE.ATR_SPECS + TE.ADX_SPECS, TE.ADX_DERIVED, TE.ADX_LATE)))
_ind_query("T11_awesome_momentum", ["ao", "mom10"], TE.with_awesome, n=8)
_ind_query("T12_macd", ["macd", "macd_signal"], lambda b: TE.smooth(b, TE.MACD_SPECS, TE.MACD_DERIVED, TE.MACD_LATE), _C)
_ind_query("T13_stochastic_rsi", ["srsi_k", "srsi_d"], lambda b: TE.with_stochastic_rsi(TE.with_rsi(TE.smooth(TE.movements(b).select("symbol", "date", "_up", "_dn"), TE.RSI_SPECS))), n=4)
_ind_query("T14_williams_r", ["willr14"], TE.with_williams)
_ind_query("T15_bull_bear_power", ["bull_power", "bear_power"], lambda b: TE.with_bull_bear(TE.smooth(b, TE.BULL_SPECS)))
_ind_query("T16_ultimate", ["uo"], TE.with_ultimate)


@query("T7_simple_rsi", f"""WITH {BARS}, x AS (SELECT *, close - lag(close) OVER {_W} AS dl FROM bars), g AS (SELECT *, CASE WHEN dl > 0 THEN dl ELSE 0 END AS up, CASE WHEN dl < 0 THEN -dl ELSE 0 END AS dn FROM x)
  SELECT symbol, date, {R(f"100 - 100 / (1 + ({_roll('avg', 'up', 14)}) / nullif({_roll('avg', 'dn', 14)}, 0))", 5)} AS rsi FROM g""")
def _(spark, d):
    return TE.simple_rsi(A.bars(spark, d)).select("symbol", "date", r("rsi", 5).alias("rsi"))


@query("T10_simple_atr", f"""WITH {BARS}, x AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER {_W}), 0), coalesce(abs(low - lag(close) OVER {_W}), 0)) AS tr FROM bars) SELECT symbol, date, {R(_roll('avg', 'tr', 14), 5)} AS atr FROM x""")
def _(spark, d):
    return TE.simple_atr(A.bars(spark, d)).select("symbol", "date", r("atr", 5).alias("atr"))


def _p(c, k=1):
    return f"lag({c}, {k}) OVER {_W}"


def _vote(buy, sell, valid):
    return f"CASE WHEN {valid} THEN CASE WHEN coalesce({sell}, false) THEN -1 WHEN coalesce({buy}, false) THEN 1 ELSE 0 END END"


def _rev(i, lo, hi):
    return _vote(f"{i} < {lo} AND {_p(i)} < {i}", f"{i} > {hi} AND {_p(i)} > {i}", f"{i} IS NOT NULL")


_VOTES = {m: _vote(f"{m} < close", f"{m} > close", f"{m} IS NOT NULL") for m in TE.MA_COLUMNS}
_VOTES["ichimoku"] = _vote("ich_lead1 > ich_lead2 AND close > ich_lead1 AND close < ich_base AND open > ich_conv AND close > ich_conv", "ich_lead1 < ich_lead2 AND close < ich_lead1 AND close > ich_base AND open < ich_conv AND close < ich_conv", "ich_lead2 IS NOT NULL")
_VOTES["rsi"] = _rev("rsi14", 30, 70)
_VOTES["stoch"] = _vote(f"stoch_k < 20 AND stoch_d < 20 AND stoch_k > stoch_d AND {_p('stoch_k')} < {_p('stoch_d')}", f"stoch_k > 80 AND stoch_d > 80 AND stoch_k < stoch_d AND {_p('stoch_k')} > {_p('stoch_d')}", "stoch_d IS NOT NULL")
_VOTES["cci"] = _rev("cci20", -100, 100)
_VOTES["adx"] = _vote(f"adx14 > 20 AND {_p('plus_di')} < {_p('minus_di')} AND plus_di > minus_di", f"adx14 > 20 AND {_p('plus_di')} > {_p('minus_di')} AND plus_di < minus_di", "adx14 IS NOT NULL")
_VOTES["ao"] = _vote(f"(ao > 0 AND {_p('ao')} < 0) OR (ao > 0 AND {_p('ao')} > 0 AND ao > {_p('ao')} AND {_p('ao', 2)} > {_p('ao')})", f"(ao < 0 AND {_p('ao')} > 0) OR (ao < 0 AND {_p('ao')} < 0 AND ao < {_p('ao')} AND {_p('ao', 2)} < {_p('ao')})", "ao IS NOT NULL")
_VOTES["mom"] = _vote(f"mom10 > {_p('mom10')}", f"mom10 < {_p('mom10')}", f"{_p('mom10')} IS NOT NULL")
_VOTES["macd"] = _vote("macd > macd_signal", "macd < macd_signal", "macd_signal IS NOT NULL")
_VOTES["srsi"] = _vote(f"close < ema50 AND srsi_k < 20 AND srsi_d < 20 AND srsi_k > srsi_d AND {_p('srsi_k')} < {_p('srsi_d')}", f"close > ema50 AND srsi_k > 80 AND srsi_d > 80 AND srsi_k < srsi_d AND {_p('srsi_k')} > {_p('srsi_d')}", "srsi_d IS NOT NULL")
_VOTES["wr"] = _rev("willr14", -80, -20)
_VOTES["bbp"] = _vote(f"close > ema50 AND bear_power < 0 AND bear_power > {_p('bear_power')}", f"close < ema50 AND bull_power > 0 AND bull_power < {_p('bull_power')}", "ema50 IS NOT NULL")
_VOTES["uo"] = _vote("uo > 70", "uo < 30", "uo IS NOT NULL")
_MA = [*TE.MA_COLUMNS, "ichimoku"]
_OSC = [k for k in _VOTES if k not in _MA]
# indicators are compared after rounding, so that float noise at equality cannot flip a vote
_ROUNDED = ", ".join(f"round({c}, 8) AS {c}" for c in dict.fromkeys([*TE.MA_COLUMNS, "ich_conv", "ich_base", "ich_lead1", "ich_lead2", "rsi14", "stoch_k", "stoch_d", "cci20", "adx14", "plus_di", "minus_di", "ao", "mom10", "macd", "macd_signal",
                                                                     "srsi_k", "srsi_d", "willr14", "bull_power", "bear_power", "uo"]))
_ROUND_COLS = [c.split(" AS ")[1] for c in _ROUNDED.split(", round")]
_MEAN = lambda ks: f"({' + '.join(f'coalesce(sig_{k}, 0)' for k in ks)})::DOUBLE / nullif({' + '.join(f'(sig_{k} IS NOT NULL)::INT' for k in ks)}, 0)"
_BIN = "CASE WHEN rating_all > .5 THEN 'strong_buy' WHEN rating_all > .1 THEN 'buy' WHEN rating_all > -.1 THEN 'neutral' WHEN rating_all > -.5 THEN 'sell' WHEN rating_all > -1.01 THEN 'strong_sell' END"
RATE_SQL = f"""{IND_SQL}, ri AS (SELECT symbol, date, open, high, low, close, volume, {_ROUNDED} FROM ind), vt AS (SELECT *, {", ".join(f"{e} AS sig_{k}" for k, e in _VOTES.items())} FROM ri),
  gm AS (SELECT *, {_MEAN(_MA)} AS rating_ma, {_MEAN(_OSC)} AS rating_osc FROM vt), rt AS MATERIALIZED (SELECT *, round((rating_ma + rating_osc) / 2, 8) AS rating_all FROM gm)"""


def rated(spark, d):
    ind = TE.indicators(A.bars(spark, d))
    ind = ind.withColumns({c: F.round(c, 8) for c in [*_ROUND_COLS, *TE.BEFORE, *TE.BEFORE_FINITE]})
    return TE.ratings(ind).withColumn("rating_all", F.round("rating_all", 8)).withColumn("rating_label", TE.rating_bin("rating_all"))


@query("T17_votes", f"WITH RECURSIVE {RATE_SQL} SELECT symbol, date, {', '.join(f'CAST(sig_{k} AS DOUBLE) AS sig_{k}' for k in _VOTES)} FROM rt")
def _(spark, d):
    return rated(spark, d).select("symbol", "date", *[F.col(f"sig_{k}").cast("double").alias(f"sig_{k}") for k in _VOTES])


@query("T18_group_scores", f"WITH RECURSIVE {RATE_SQL} SELECT symbol, date, {R('rating_ma')} AS rating_ma, {R('rating_osc')} AS rating_osc, {R('rating_all')} AS rating_all FROM rt")
def _(spark, d):
    return rated(spark, d).select("symbol", "date", *[r(c).alias(c) for c in ("rating_ma", "rating_osc", "rating_all")])


@query("T19_rating_labels", f"WITH RECURSIVE {RATE_SQL} SELECT symbol, {_BIN} AS rating_label, count(*) AS n FROM rt GROUP BY ALL")
def _(spark, d):
    return rated(spark, d).groupBy("symbol", "rating_label").agg(F.count("*").alias("n"))


@query("T20_rating_panel", f"WITH RECURSIVE {RATE_SQL.replace('FROM bars)', 'FROM bars WHERE date >= DATE ' + chr(39) + '1999-01-01' + chr(39) + ' - 320)', 1)} SELECT symbol, date, {R('rating_all')} AS rating_all, {_BIN} AS rating_label FROM rt WHERE date >= DATE '1999-01-01'")
def _(spark, d):
    b = A.bars(spark, d)
    ind = TE.indicators(b.where("date >= date_sub(date'1999-01-01', 320)")).withColumns({c: F.round(c, 8) for c in [*_ROUND_COLS, *TE.BEFORE, *TE.BEFORE_FINITE]})
    p = TE.ratings(ind).withColumn("rating_all", F.round("rating_all", 8)).withColumn("rating_label", TE.rating_bin("rating_all")).where("date >= date'1999-01-01'")
    return p.select("symbol", "date", r("rating_all").alias("rating_all"), "rating_label")


def _cross_sql(a, b, direction, incl):
    pb = b if isinstance(b, (int, float)) else _p(b)
    now, before = {("up", False): (">", "<="), ("down", False): ("<", ">="), ("up", True): (">=", "<"), ("down", True): ("<=", ">")}[(direction, incl)]
    return f"coalesce({a} {now} {b} AND {_p(a)} {before} {pb}, false)"


@query("T21_named_signals", f"WITH RECURSIVE {RATE_SQL}, s AS (SELECT symbol, date, unnest([{', '.join(chr(39) + n + chr(39) for n in TE.NAMED_SIGNALS)}]) AS signal, unnest([{', '.join(_cross_sql(*v) for v in TE.NAMED_SIGNALS.values())}]) AS hit FROM rt) SELECT symbol, date, signal FROM s WHERE hit")
def _(spark, d):
    return TE.technical_events(rated(spark, d), list(TE.NAMED_SIGNALS))


_ST = f"""{IND_SQL}, sb AS MATERIALIZED (SELECT symbol, date, i, high, low, close, pc, round((high + low) / 2 - 3 * atr10, 8) AS lo, round((high + low) / 2 + 3 * atr10, 8) AS hi, round(atr10, 8) AS atr10 FROM ind),
  sl AS MATERIALIZED (SELECT *, lag(lo) OVER {_W} AS plo, lag(hi) OVER {_W} AS phi FROM sb),
  st AS (SELECT symbol, i, lo AS l, hi AS h, 1 AS t FROM sl WHERE i = 1 UNION ALL SELECT symbol, i, l, h, CASE WHEN close > h THEN 1 WHEN close < l THEN -1 ELSE t END FROM (SELECT s.symbol, s.i, s.close, st.t,
     CASE WHEN s.pc > s.plo THEN greatest(s.lo, st.l) ELSE s.lo END AS l, CASE WHEN s.pc < s.phi THEN least(s.hi, st.h) ELSE s.hi END AS h FROM st JOIN sl s ON s.symbol = st.symbol AND s.i = st.i + 1)),
  sd AS MATERIALIZED (SELECT sb.*, CASE WHEN t = 1 THEN l ELSE h END AS line, -t AS direction FROM sb JOIN st USING (symbol, i))"""


def _supertrend(spark, d):
    st = TE.supertrend(A.bars(spark, d))
    return st


@query("T22_supertrend", f"WITH RECURSIVE {_ST} SELECT symbol, date, {R('line', 5)} AS st_line, CAST(direction AS DOUBLE) AS direction FROM sd")
def _(spark, d):
    return _supertrend(spark, d).select("symbol", "date", r("st_line", 5).alias("st_line"), "direction")


@query("T23_trailing_stop", f"""WITH RECURSIVE {BARS}, x AS MATERIALIZED (SELECT *, row_number() OVER {_W} AS i, lag(close) OVER {_W} AS pc, greatest(high - low, coalesce(abs(high - lag(close) OVER {_W}), 0), coalesce(abs(low - lag(close) OVER {_W}), 0)) AS tr FROM bars),
  y AS MATERIALIZED (SELECT *, coalesce({_roll('avg', 'tr', 10)}, 0) AS loss FROM x),
  tr AS (SELECT symbol, i, close AS trail FROM y WHERE i = 1 UNION ALL SELECT y.symbol, y.i, CASE WHEN y.close > tr.trail AND y.pc > tr.trail THEN greatest(tr.trail, y.close - loss) WHEN y.close < tr.trail AND y.pc < tr.trail THEN least(tr.trail, y.close + loss)
    WHEN y.close > tr.trail THEN y.close - loss ELSE y.close + loss END FROM tr JOIN y ON y.symbol = tr.symbol AND y.i = tr.i + 1), z AS (SELECT y.symbol, y.date, y.close, tr.trail FROM y JOIN tr USING (symbol, i))
  SELECT symbol, date, {R('trail', 5)} AS trail, {_cross_sql('close', 'trail', 'up', False)} AS entry, {_cross_sql('close', 'trail', 'down', False)} AS exit FROM z""")
def _(spark, d):
    return TE.trailing_stop(A.bars(spark, d)).select("symbol", "date", r("trail", 5).alias("trail"), "entry", "exit")


@query("T24_cross_rules", f"WITH RECURSIVE {IND_SQL} SELECT symbol, date, {_cross_sql('e9', 'e21', 'up', False)} AS entry, {_cross_sql('e9', 'e21', 'down', False)} AS exit FROM ind")
def _(spark, d):
    return TE.ma_cross(A.bars(spark, d), 9, 21).select("symbol", "date", "entry", "exit")


@query("T24_rsi_threshold", f"""WITH {BARS}, x AS (SELECT *, close - lag(close) OVER {_W} AS dl FROM bars), g AS (SELECT *, CASE WHEN dl > 0 THEN dl ELSE 0 END AS up, CASE WHEN dl < 0 THEN -dl ELSE 0 END AS dn FROM x),
  q AS (SELECT symbol, date, 100 - 100 / (1 + ({_roll('avg', 'up', 14)}) / nullif({_roll('avg', 'dn', 14)}, 0)) AS rsi FROM g) SELECT symbol, date, {_cross_sql('rsi', 30, 'up', False)} AS entry, {_cross_sql('rsi', 70, 'down', False)} AS exit FROM q""")
def _(spark, d):
    return TE.rsi_threshold(A.bars(spark, d)).select("symbol", "date", "entry", "exit")


_VCP = {**TE.VCP, "ma": (10, 20, 30), "up_lookback": 5, "rank_len": 30, "rank_max": 60.0}


@query("T25_contraction_breakout", f"""WITH {BARS}, a AS (SELECT *, {_roll('avg', 'close', 10)} AS ma, {_roll('avg', 'close', 20)} AS mb, {_roll('avg', 'close', 30)} AS mc, {_roll('max', 'high', 3)} AS hh, {_roll('min', 'low', 3)} AS ll,
   {_roll('max', 'close', 3)} AS hc, {_roll('min', 'close', 3)} AS lc, {_roll('avg', 'volume', 20)} AS vm FROM bars),
  b AS (SELECT *, (hh - ll) / hh * 100 AS rng, (hc - lc) / hc * 100 AS crng FROM a), c AS (SELECT *, list(rng) FILTER (rng IS NOT NULL) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS pr FROM b),
  e AS (SELECT *, CASE WHEN len(pr) = 30 THEN len(list_filter(pr, lambda v: v <= rng)) * 100.0::DOUBLE / 30 END AS rk FROM c), f AS (SELECT *, coalesce(rk <= 60, false) OR coalesce(crng <= 4, false) AS squeeze FROM e)
  SELECT symbol, date, {R('rk', 4)} AS range_rank, squeeze, coalesce(close > ma AND ma > mb AND mb > mc AND mc > {_p('mc')} AND mc > {_p('mc', 5)} AND ma >= {_p('ma')} AND squeeze AND volume > vm * 1.2 AND close > {_p('hh')}, false) AS entry FROM f""")
def _(spark, d):
    return TE.contraction_breakout(A.bars(spark, d), _VCP).select("symbol", "date", r("range_rank", 4).alias("range_rank"), "squeeze", "entry")


_LV = lambda flag, x: f"last_value(CASE WHEN {flag} THEN {x} END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("T26_risk_levels", f"""WITH RECURSIVE {_ST}, f AS (SELECT *, {_cross_sql('direction', 0, 'down', False)} AS buy, {_cross_sql('direction', 0, 'up', False)} AS sell FROM sd),
  g AS (SELECT *, {_LV('buy', 'close - atr10 * 1.5')} AS ls, {_LV('buy', 'close + atr10 * 1.5')} AS lt FROM f)
  SELECT symbol, date, buy, sell, {R('ls', 4)} AS long_stop, {R('lt', 4)} AS long_target, sell OR coalesce(high >= lt OR low <= ls, false) AS long_exit FROM g""")
def _(spark, d):
    return TE.risk_levels(_supertrend(spark, d)).select("symbol", "date", "buy", "sell", r("long_stop", 4).alias("long_stop"), r("long_target", 4).alias("long_target"), "long_exit")
