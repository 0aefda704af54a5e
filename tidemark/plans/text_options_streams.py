"""Text, option and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import pricing as PR
from tidemark.operators import dedup as D, features as FE, options as OP, reports as RP, text as TX
from tidemark.plans.base import query, r, rounded
from tidemark.plans.reports import _DTE, _MNY, _ZONE, _binned
from tidemark.plans.sqlbits import BARS, CONTRACTS, NEWS, POSITIONS, R, normal_tail as _TAIL
from tidemark.plans.windows import market
from tidemark.sources import adapters as A
from tidemark.sources.workspace import fresh_path
from tidemark.streaming import alerts as AL, feeds as SF

# fixed values: everyday words given a valence, so that the invented prose has something to score
DEMO_LEXICON = {"the": 0.5, "of": 0.25, "that": -1.0, "les": 1.0, "des": -0.5, "une": 0.75, "der": 1.25, "die": -0.75, "und": 0.5, "el": 1.0, "la": -1.5, "que": 0.5}
LEXICON = {**TX.FINANCE_LEXICON, **DEMO_LEXICON}
_LEX_SQL = "lex(word, valence) AS (VALUES " + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON.items()) + ")"
_TXT = """tx AS (SELECT doc_id, split_part(text, chr(10), 1) AS headline, substr(text, length(split_part(text, chr(10), 1)) + 2) AS summary FROM documents)"""


def texts(spark, d):
    """First line as headline, everything after it as summary."""
    t = A.table(spark, d, "documents")
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    return t.select("doc_id", head.alias("headline"), F.substring(F.col("text"), F.length(head) + 2, F.length("text")).alias("summary"))


def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "word string, valence double")


_X10 = f"""{_TXT}, {_LEX_SQL}, ws AS (SELECT doc_id, 'h' AS part, unnest(regexp_extract_all(lower(headline), '\\p{{L}}[\\p{{L}}''-]*')) AS word FROM tx UNION ALL SELECT doc_id, 's', unnest(regexp_extract_all(lower(summary), '\\p{{L}}[\\p{{L}}''-]*')) FROM tx),
  pp AS (SELECT doc_id, part, coalesce(sum(valence), 0) AS v, count(*) AS n, count(valence) AS h FROM ws LEFT JOIN lex USING (word) GROUP BY 1, 2), wd AS (SELECT doc_id, max(v) FILTER (part = 'h') AS hv, max(n) FILTER (part = 'h') AS hn, max(h) FILTER (part = 'h') AS hh, max(v) FILTER (part = 's') AS sv, max(n) FILTER (part = 's') AS sn, max(h) FILTER (part = 's') AS sh FROM pp GROUP BY 1),
  q AS (SELECT doc_id, coalesce(hv / sqrt(hv * hv + 15), 0) AS a, coalesce(sv / sqrt(sv * sv + 15), 0) AS b, coalesce(1 - hh / hn::DOUBLE, 1) AS na, coalesce(1 - sh / sn::DOUBLE, 1) AS nb, coalesce(sn, 0) > 0 AS two FROM documents LEFT JOIN wd USING (doc_id)),
  z AS (SELECT doc_id, round(CASE WHEN two THEN 0.7 * a + 0.3 * b ELSE a END, 9) AS score, CASE WHEN two THEN 0.7 * na + 0.3 * nb ELSE na END AS neutral FROM q), sn AS MATERIALIZED (SELECT doc_id, score, neutral, CASE WHEN score >= 0.1 THEN 'bullish' WHEN score <= -0.1 THEN 'bearish' ELSE 'neutral' END AS sentiment FROM z)"""


@query("X10_lexicon_sentiment", f"WITH {_X10} SELECT doc_id, {R('score')} AS score, sentiment, {R('CASE WHEN sentiment = chr(110) || chr(101) || chr(117) || chr(116) || chr(114) || chr(97) || chr(108) THEN neutral ELSE least(1, (1 - neutral) * 0.5 + abs(score) * 0.5) END', 5)} AS confidence FROM sn".replace("chr(110) || chr(101) || chr(117) || chr(116) || chr(114) || chr(97) || chr(108)", "'neutral'"))
def _(spark, d):
    s = TX.article_sentiment(texts(spark, d), "doc_id", "headline", "summary", lexicon(spark))
    return s.select("doc_id", r("score").alias("score"), "sentiment", r("confidence", 5).alias("confidence"))


@query("X11_alias_dictionary", """WITH n AS (SELECT c_custkey AS symbol, c_mktsegment || ' Works ' || c_custkey || CASE c_nationkey % 4 WHEN 0 THEN ' Group Inc.' WHEN 1 THEN ' Holdings' WHEN 2 THEN ' Co' ELSE '' END AS name FROM customer),
  a AS (SELECT symbol, name AS alias FROM n UNION SELECT symbol, trim(regexp_replace(name, '(?i)\\s+(inc|corp|co|companies|company|corporation|group|international|holdings?)\\.?$', '')) FROM n UNION
   SELECT symbol, trim(regexp_replace(trim(regexp_replace(name, '(?i)\\s+(inc|corp|co|companies|company|corporation|group|international|holdings?)\\.?$', '')), '(?i)\\s+(inc|corp|co|companies|company|corporation|group|international|holdings?)\\.?$', '')) FROM n UNION SELECT s_suppkey, s_name FROM supplier)
  SELECT symbol, min(alias) AS alias FROM a WHERE alias <> '' GROUP BY symbol, lower(alias)""")
def _(spark, d):
    k = F.col("c_nationkey") % 4
    name = F.concat(F.col("c_mktsegment"), F.lit(" Works "), F.col("c_custkey"), F.when(k == 0, " Group Inc.").when(k == 1, " Holdings").when(k == 2, " Co").otherwise(""))
    manual = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("alias"))
    return TX.alias_dictionary(A.table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), name.alias("name")), manual)


# aliases: the whole benchmark passages, which documents quote
_AL = "al AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS symbol, text AS alias FROM benchmark)"
_HIT = lambda col: f"regexp_matches(lower({col}), '(^|[^\\p{{L}}\\p{{N}}_$])' || regexp_escape(lower(alias)) || '($|[^\\p{{L}}\\p{{N}}_])')"


def aliases(spark, d):
    return A.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("symbol"), F.col("text").alias("alias"))


@query("X12_entity_mentions", f"WITH {_AL} SELECT DISTINCT doc_id, symbol FROM documents JOIN al ON alias <> '' AND {_HIT('text')}")
def _(spark, d):
    return TX.mentions(A.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", aliases(spark, d))


# fixed values: demo drivers for the invented prose
DEMO_DRIVERS = {"oil": r"\bthe\b", "gold": r"\bles\b", "vix": r"\bund\b"}


@query("X13_relevance", f"""WITH {_TXT}, {_AL}, di AS (SELECT doc_id, symbol, 1.0 AS s, true AS d FROM tx JOIN al ON alias <> '' AND {_HIT('headline')} UNION ALL SELECT doc_id, symbol, 0.7, true FROM tx JOIN al ON alias <> '' AND {_HIT('summary')}),
  ex AS (SELECT symbol, dv, abs(t) AS a FROM (SELECT CAST(item_id AS VARCHAR) AS symbol, 'oil' AS dv, item_id % 9 * 3.0 AS t FROM benchmark UNION ALL SELECT CAST(item_id AS VARCHAR), 'gold', -(item_id % 7) * 2.0 FROM benchmark)), pat(dv, p) AS (VALUES {', '.join(f"('{k}', '(^|[^\\p{{L}}\\p{{N}}_])' || '{v[2:-2]}' || '($|[^\\p{{L}}\\p{{N}}_])')" for k, v in DEMO_DRIVERS.items())}),
  tg AS (SELECT doc_id, dv FROM tx JOIN pat ON regexp_matches(lower(headline || ' ' || summary), p)), ow AS (SELECT doc_id, CAST(doc_id % 40 AS VARCHAR) AS symbol FROM tx), ii AS (SELECT doc_id, symbol, CASE WHEN a >= 3 THEN round(0.6 * (0.5 + 0.5 * least(1, (a - 3) / 17)), 3) ELSE 0 END AS s, false AS d FROM tg JOIN ow USING (doc_id) JOIN ex USING (symbol, dv)),
  bs AS (SELECT doc_id, symbol, max(s) AS s, bool_or(d) AS d FROM (SELECT * FROM di UNION ALL SELECT * FROM ii) GROUP BY 1, 2)
  SELECT doc_id, symbol, CAST(round(coalesce(s, 0), 3) AS DOUBLE) AS relevance, coalesce(d, false) AS direct FROM ow LEFT JOIN bs USING (doc_id, symbol)""")
def _(spark, d):
    b = A.table(spark, d, "benchmark")
    ex = b.select(F.col("item_id").alias("symbol"), F.lit("oil").alias("driver"), (F.col("item_id") % 9 * 3.0).alias("t")).unionByName(b.select(F.col("item_id").alias("symbol"), F.lit("gold").alias("driver"), (-(F.col("item_id") % 7) * 2.0).alias("t")))
    art = texts(spark, d).withColumn("symbol", F.col("doc_id") % 40)
    return TX.relevance(art, "doc_id", "symbol", "headline", "summary", aliases(spark, d), ex, DEMO_DRIVERS)


@query("X14_direct_mention_signals", f"""WITH {_X10}, {_AL}, m AS (SELECT DISTINCT doc_id, symbol FROM documents JOIN al ON alias <> '' AND {_HIT('text')}) SELECT symbol, {R('sum(score * greatest(0.5, 0.05)) / sum(greatest(0.5, 0.05))')} AS sent_score, count(*) AS n_articles FROM m JOIN sn USING (doc_id) GROUP BY 1""")
def _(spark, d):
    m = TX.mentions(A.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", aliases(spark, d))
    s = TX.article_sentiment(texts(spark, d), "doc_id", "headline", "summary", lexicon(spark)).withColumn("score", F.round("score", 9))
    j = m.join(s, "doc_id").select("symbol", F.lit("2024-01-01").cast("date").alias("date"), "score", F.lit(0.5).alias("confidence"))
    return RP.daily_signals(j).select("symbol", r("sent_score").alias("sent_score"), "n_articles")


@query("X15_unseen_headlines", f"WITH {_TXT} SELECT DISTINCT headline FROM tx WHERE headline NOT IN (SELECT split_part(text, chr(10), 1) FROM benchmark)")
def _(spark, d):
    cache = A.table(spark, d, "benchmark").select(F.split_part("text", F.lit("\n"), F.lit(1)).alias("headline"))
    return TX.unseen_headlines(texts(spark, d), cache, "headline")


# --- options ---------------------------------------------------------------------------------

_CURVE = [(0.25, 3.0), (0.5, 3.2), (1.0, 3.6), (2.0, 4.0), (10.0, 4.6)]  # tenor in years, percent
_CDF = lambda x: f"(CASE WHEN {x} > 0 THEN 1 - ({_TAIL(x)}) ELSE {_TAIL(x)} END)"


def curve_column(spark_date):
    """A small curve whose level moves with the year."""
    lift = (F.year(spark_date) - 1995) / 10.0
    return F.array(*[F.struct(F.lit(t).alias("tenor"), (F.lit(p) + lift).alias("pct")) for t, p in _CURVE])


def _rate_sql(t):
    pts = _CURVE
    out = f"CASE WHEN {t} <= {pts[0][0]} THEN {pts[0][1]} "
    for (t0, p0), (t1, p1) in zip(pts, pts[1:]):
        out += f"WHEN {t} <= {t1} THEN {p0} + ({t} - {t0}) / ({t1} - {t0}) * ({p1} - {p0}) "
    return f"ln(1 + (({out} ELSE {pts[-1][1]} END)::DOUBLE + (year(date) - 1995) / 10.0) / 100)"


@query("O2_curve_interpolation", f"WITH {BARS} SELECT symbol, date, volume, {R(_rate_sql('(volume / 20.0)'), 9)} AS r FROM bars")
def _(spark, d):
    b = A.bars(spark, d).select("symbol", "date", "volume")
    return b.withColumn("r", r(OP.curve_rate(curve_column("date"), F.col("volume") / 20.0), 9))


def option_base(spark, d):
    """Every bar that has its close-to-close estimate, with the estimates of all three methods."""
    bars = A.bars(spark, d)
    b = FE.overlay_vol(FE.yang_zhang(bars, 30), market(bars).withColumnRenamed("bench", "level"), 30).where("cc_vol is not null")
    return b.select("symbol", "date", F.col("close").alias("spot"), F.lit(0.01).alias("q"), *[F.round(c, 6).alias(s) for c, s in (("cc_vol", "sigma_cc"), ("yz_vol", "sigma_yz"), ("vix_vol", "sigma_vix"))])


def rates(spark, d):
    """Of every day with a trade: the days need no bars."""
    return OP.rate_table(A.trades(spark, d).select("date").distinct().withColumn("curve", curve_column("date")), DTES)


MNY, DTES = [0.8, 0.9, 1.0, 1.1, 1.2], [7, 30, 90]
_GRID = f"""{BARS}, lr AS (SELECT symbol, date, close, ln(close / lag(close) OVER w) AS lr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
  vs AS (SELECT symbol, date, close AS spot, round(CASE WHEN count(lr) OVER t >= 30 THEN stddev_samp(lr) OVER t END * sqrt(252), 6) AS sigma FROM lr WINDOW t AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
  lt AS (SELECT * FROM vs WHERE sigma IS NOT NULL),
  gd AS (SELECT symbol, date, spot, sigma, m AS moneyness, n AS dte, c AS contract_type, round(m * spot + 1e-9, 2) AS strike, n / 365.0::DOUBLE AS t, CASE c WHEN 'CALL' THEN 1 ELSE -1 END AS s FROM lt, (VALUES {', '.join(f'({m}::DOUBLE)' for m in MNY)}) a(m), (VALUES {', '.join(f'({n})' for n in DTES)}) b(n), (VALUES ('CALL'), ('PUT')) c(c)),
  gr AS (SELECT *, {_rate_sql('t')} AS r FROM gd), g1 AS (SELECT *, (ln(spot / strike) + (r - 0.01 + sigma * sigma / 2) * t) / (sigma * sqrt(t)) AS d1 FROM gr), g2 AS (SELECT *, d1 - sigma * sqrt(t) AS d2, exp(-d1 * d1 / 2) / 2.506628274631::DOUBLE AS pdf FROM g1),
  g3 AS (SELECT *, {_CDF('(s * d1)')} AS n1, {_CDF('(s * d2)')} AS n2 FROM g2)"""


@query("O1_option_grid_european", f"""WITH {_GRID} SELECT symbol, date, moneyness, dte, contract_type, {R('s * (spot * exp(-0.01 * t) * n1 - strike * exp(-r * t) * n2)')} AS theo_price, {R('s * exp(-0.01 * t) * n1')} AS delta, {R('exp(-0.01 * t) * pdf / (spot * sigma * sqrt(t))', 8)} AS gamma,
  {R('(-(spot * pdf * sigma * exp(-0.01 * t)) / (2 * sqrt(t)) - s * r * strike * exp(-r * t) * n2 + s * 0.01 * spot * exp(-0.01 * t) * n1) / 365')} AS theta, {R('spot * exp(-0.01 * t) * pdf * sqrt(t) / 100')} AS vega, {R('s * strike * t * exp(-r * t) * n2 / 100')} AS rho FROM g3""")
def _(spark, d):
    base = option_base(spark, d)
    p = PR.european_both(OP.option_grid(base, rates(spark, d), MNY, DTES, {"close_to_close": "sigma_cc"}))
    return p.select("symbol", "date", "moneyness", "dte", "contract_type", *[r(c, 8 if c == "gamma" else 6).alias(c) for c in PR.GREEKS])


_METHODS = {"close_to_close": "sigma_cc", "yang_zhang": "sigma_yz", "index_overlay": "sigma_vix"}
_GRID3 = _GRID[_GRID.index(" gd AS"):].replace(" FROM lt,", ", vol_method FROM lt,")


@query("O1_option_grid_vol_methods", f"""WITH {BARS}, bm AS (SELECT date, sum(CAST(close * 10000 AS BIGINT)) / count(*)::DOUBLE / 10000 AS lv FROM bars GROUP BY 1), ov AS (SELECT date, CASE WHEN count(*) OVER w >= 7 THEN lv / avg(lv) OVER w END AS overlay FROM bm WINDOW w AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
  x AS (SELECT symbol, date, close, ln(close / lag(close) OVER w) AS lr, ln(open / lag(close) OVER w) AS o, ln(close / open) AS c, ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open)) AS rs FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
  m AS (SELECT symbol, date, close AS spot, CASE WHEN count(lr) OVER w >= 30 THEN stddev_samp(lr) OVER w END * sqrt(252) AS cc, CASE WHEN count(o) OVER w >= 30 THEN
    sqrt(greatest(var_samp(o) OVER w + (0.34 / (1.34 + 31.0 / 29.0))::DOUBLE * var_samp(c) OVER w + (1 - 0.34 / (1.34 + 31.0 / 29.0))::DOUBLE * avg(rs) OVER w, 0) * 252) END AS yz FROM x WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
  lt AS (SELECT symbol, date, spot, vol_method, sigma FROM (SELECT symbol, date, spot, unnest(['close_to_close', 'yang_zhang', 'index_overlay']) AS vol_method, unnest([round(cc, 6), round(yz, 6), round(cc * overlay, 6)]) AS sigma FROM m JOIN ov USING (date) WHERE cc IS NOT NULL) WHERE sigma IS NOT NULL),{_GRID3}
  SELECT date, moneyness, dte, contract_type, vol_method, count(*) AS n, {R('sum(sigma)')} AS sigma_total, {R('avg(s * (spot * exp(-0.01 * t) * n1 - strike * exp(-r * t) * n2))', 5)} AS theo_price, {R('avg(s * exp(-0.01 * t) * n1)', 5)} AS delta, {R('avg(spot * exp(-0.01 * t) * pdf * sqrt(t) / 100)', 5)} AS vega FROM g3 GROUP BY ALL""")
def _(spark, d):
    """All contracts under three volatility methods, averaged over the symbols of a day; calls and puts are averaged side by side."""
    kinds, means = {"CALL": "call", "PUT": "put"}, ("theo_price", "delta", "vega")
    p = PR.european_pair(OP.option_grid(option_base(spark, d), rates(spark, d), MNY, DTES, _METHODS))
    out = p.groupBy("date", "moneyness", "dte", "vol_method").agg(F.count("*").alias("n"), r(F.sum("sigma")).alias("sigma_total"), *[F.avg(F.col(k)[c]).alias(f"{k}_{c}") for k in kinds.values() for c in means])
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("contract_type"), *[r(f"{k}_{c}", 5).alias(c) for c in means]) for n, k in kinds.items()]))
    return out.select("date", "moneyness", "dte", "vol_method", "n", "sigma_total", sides.alias("_s")).select("date", "moneyness", "dte", "_s.contract_type", "vol_method", "n", "sigma_total", *[f"_s.{c}" for c in means])


@query("O4_iv_source_fallback", f"""WITH {CONTRACTS}, c AS (SELECT *, CASE WHEN symbol % 3 = 0 THEN 'broker_chain' ELSE 'vendor_chain' END AS source, CASE WHEN symbol % 3 = 0 THEN iv * 2 ELSE iv END AS vol FROM contracts), n AS (SELECT symbol, max(snapshot_date) AS date FROM contracts GROUP BY 1)
  SELECT c.symbol, c.snapshot_date AS date, expiration, put_call AS contract_type, source, {R('avg(vol)', 4)} AS avg_iv, {R('min(vol)', 4)} AS min_iv, {R('max(vol)', 4)} AS max_iv, count(strike5) AS n_contracts FROM c JOIN n ON c.symbol = n.symbol AND c.snapshot_date = n.date GROUP BY ALL""")
def _(spark, d):
    """The first source covers every third symbol only; all others come from the second."""
    c = A.contracts(spark, d)
    vendor = c.select("symbol", F.col("snapshot_date").alias("date"), "expiration", F.lower("put_call").alias("contract_type"), F.col("strike5").alias("strike_price"), F.col("iv").alias("volatility"))
    broker = c.where("symbol % 3 = 0").select("symbol", F.col("snapshot_date").alias("date"), "expiration", "put_call", F.col("strike5").alias("strike"), (F.col("iv") * 2).alias("implied_volatility"))
    return OP.iv_summary(OP.iv_source({"broker_chain": broker, "vendor_chain": vendor}))


# --- streams ---------------------------------------------------------------------------------

def position_stream(spark, d):
    schema = A.table(spark, d, "events").schema
    return A.positions_of(SF.file_stream(spark, d, "events.parquet", schema)).withColumn("ts", F.col("ts").cast("timestamp"))


@query("X20_stream_dedup", f"WITH {POSITIONS} SELECT mmsi, nav_status, count(*) AS n FROM (SELECT DISTINCT mmsi, nav_status, date_trunc('hour', ts) FROM positions) GROUP BY 1, 2")
def _(spark, d):
    s = position_stream(spark, d).withColumn("hour", F.date_trunc("hour", "ts"))
    out = SF.drain(SF.dedup_positions(s, ["mmsi", "nav_status", "hour"], delay="45 days").select("mmsi", "nav_status", "hour"))
    return out.groupBy("mmsi", "nav_status").agg(F.count("*").alias("n"))


_VES = "ves AS (SELECT c_custkey AS mmsi, 60 + c_nationkey AS static_type FROM customer WHERE c_nationkey % 3 <> 0)"


@query("X21_stream_enrichment", f"""WITH {POSITIONS}, {_VES} SELECT coalesce(v, 'unknown') AS vessel, count(*) AS n FROM (SELECT CASE WHEN static_type IS NULL THEN NULL WHEN static_type BETWEEN 70 AND 79 THEN 'cargo' WHEN static_type BETWEEN 80 AND 89 THEN 'tanker' WHEN static_type BETWEEN 60 AND 69 THEN 'passenger' ELSE 'other' END AS v
  FROM positions LEFT JOIN ves USING (mmsi)) WHERE v IS NULL OR v IN ('cargo','tanker') GROUP BY 1""")
def _(spark, d):
    ves = A.table(spark, d, "customer").where("c_nationkey % 3 <> 0").select(F.col("c_custkey").alias("mmsi"), (60 + F.col("c_nationkey")).alias("static_type"))
    out = SF.drain(SF.enrich_positions(position_stream(spark, d), ves, ["cargo", "tanker"]).select("event_id", "vessel"))
    return out.groupBy(F.coalesce("vessel", F.lit("unknown")).alias("vessel")).agg(F.count("*").alias("n"))


@query("X22_stream_zone_tags", f"WITH {POSITIONS} SELECT event_id, {_ZONE} AS zone FROM positions")
def _(spark, d):
    return SF.drain(SF.tag_zones(position_stream(spark, d)).select("event_id", "zone")).select("event_id", "zone")


_UW = "100.0::DOUBLE * count(*) FILTER (nav_status = 'Under way') / count(nav_status)"


_HOUR = "date_trunc('hour', ts)"


def _zone_sql(start):
    return f"SELECT {start} AS window_start, {_ZONE} AS zone, count(*) AS position_reports, count(DISTINCT mmsi) AS vessels, {R('avg(speed)', 8)} AS avg_speed, {R(_UW, 4)} AS pct_underway"


def _zone_report(spark, d, slide=None):
    parts = SF.drain(SF.zone_windows(SF.tag_zones(position_stream(spark, d)), slide=slide), "update")
    out = SF.zone_summary(SF.latest_update(parts, ["window_start", "zone", "mmsi"]))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "zone", "position_reports", "vessels", r("avg_speed", 8).alias("avg_speed"), r("pct_underway", 4).alias("pct_underway"))


@query("X23_stream_zone_windows", f"WITH {POSITIONS} {_zone_sql(_HOUR)} FROM positions GROUP BY 1, 2")
def _(spark, d):
    return _zone_report(spark, d)


@query("X23_stream_sliding_windows", f"WITH {POSITIONS}, w AS (SELECT *, time_bucket(INTERVAL 30 MINUTE, ts) - unnest([INTERVAL 0 MINUTE, INTERVAL 30 MINUTE]) AS start FROM positions) {_zone_sql('start')} FROM w GROUP BY 1, 2")
def _(spark, d):
    return _zone_report(spark, d, "30 minutes")


@query("X24_stream_latest_upsert", """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def _(spark, d):
    schema = A.table(spark, d, "events").schema
    s = SF.file_stream(spark, d, "events.parquet", schema).select("user_id", "event_type", "event_id", "ts")
    return SF.upsert_latest(s, ["user_id", "event_type"], ["ts", "event_id"], fresh_path(spark, "upsert")).select("user_id", "event_type", "event_id")


@query("X25_stream_crossing_alerts", """SELECT key, ts, value FROM (SELECT user_id AS key, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, value) AS p FROM events
  WHERE ts <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)) WHERE value > 100 AND NOT coalesce(p > 100, false)""")
def _(spark, d):
    """Alerts up to the watermark; the last hour waits in the state for the next run."""
    schema = A.table(spark, d, "events").schema
    s = SF.file_stream(spark, d, "events.parquet", schema).select(F.col("user_id").alias("key"), "ts", "value")
    return SF.drain(AL.crossing_alerts(s, 100.0, delay="1 hour")).select("key", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
