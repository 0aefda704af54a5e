"""Scalar-function and aggregation queries."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from tidemark.functions import exprs as X
from tidemark.operators import dedup as D, reports as RP, text as TX
from tidemark.operators.relational import union_all
from tidemark.plans.base import query, r, rounded
from tidemark.plans.sqlbits import BARS, CONTRACTS, FACTS, HOLDINGS, INSIDER, MACRO, NEWS, POSITIONS, R, SECURITIES, SHORT
from tidemark.sources import adapters as A


@query("F1_predicates", "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM lineitem WHERE l_suppkey IN (3, 7, 11) AND l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'R'")
def _(spark, d):
    li = A.table(spark, d, "lineitem")
    return li.where(F.col("l_suppkey").isin(3, 7, 11) & F.col("l_quantity").between(10, 20) & (F.col("l_returnflag") == "R")).select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


@query("F2_relative_window", f"WITH {FACTS} SELECT symbol, metric, filed, value FROM facts WHERE filed BETWEEN DATE '1998-06-15' - 7 AND DATE '1998-06-15' + 30")
def _(spark, d):
    asof = F.lit("1998-06-15").cast("date")
    return A.facts(spark, d).where(F.col("filed").between(F.date_sub(asof, 7), F.date_add(asof, 30))).select("symbol", "metric", "filed", "value")


@query("F3_null_safe_ratio", f"SELECT c_custkey, {R('CASE WHEN c_acctbal > 0 THEN c_nationkey / c_acctbal END')} AS ratio, {R('c_acctbal / nullif(c_nationkey, 0)')} AS safe FROM customer")
def _(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", r(X.ratio("c_nationkey", "c_acctbal")).alias("ratio"), r(X.safe_div("c_acctbal", "c_nationkey")).alias("safe"))


@query("F4_math", """SELECT p_partkey, round(ln(p_retailprice), 6) AS l, round(sqrt(p_retailprice), 6) AS s, round(exp(p_size / 50.0::DOUBLE), 6) AS e, round(pow(p_size, 1.5), 4) AS p,
  greatest(10, least(30, p_size)) AS clipped, round_even(p_size / 4.0::DOUBLE, 0) AS half_even FROM part""")
def _(spark, d):
    p = A.table(spark, d, "part")
    return p.select("p_partkey", r(F.log("p_retailprice")).alias("l"), r(F.sqrt("p_retailprice")).alias("s"), r(F.exp(F.col("p_size") / 50.0)).alias("e"),
                    r(F.pow("p_size", F.lit(1.5)), 4).alias("p"), X.clip(F.col("p_size"), 10, 30).cast("int").alias("clipped"), F.bround(F.col("p_size") / 4.0, 0).alias("half_even"))


@query("F5_text_predicates", """SELECT p_partkey, upper(p_type) AS kind, lower(p_brand) AS brand FROM part WHERE regexp_matches(lower(p_name), 'red|blue|ring') AND contains(p_brand, '1')""")
def _(spark, d):
    p = A.table(spark, d, "part")
    return p.where(F.lower("p_name").rlike("red|blue|ring") & F.contains("p_brand", F.lit("1"))).select("p_partkey", F.upper("p_type").alias("kind"), F.lower("p_brand").alias("brand"))


@query("F6_business_day_shift", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), c AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM
  (SELECT CAST(unnest(generate_series(DATE '1994-12-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) <= 5),
  b AS (SELECT o_orderkey, o.d, (SELECT max(i) FROM c WHERE c.d <= o.d) AS i FROM o)
  SELECT o_orderkey, b.d AS date, c1.d AS plus_1, c7.d AS plus_7 FROM b JOIN c c1 ON c1.i = b.i + 1 JOIN c c7 ON c7.i = b.i + 7""")
def _(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return o.withColumns({"plus_1": X.business_day_shift("date", 1), "plus_7": X.business_day_shift("date", 7)})


@query("F7_hash_split", """SELECT c_custkey, ('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 63, 2))::INTEGER % 4 = 0 AS holdout FROM customer""")
def _(spark, d):
    return A.table(spark, d, "customer").select("c_custkey", (X.hash_share("c_custkey") == 0).alias("holdout"))


@query("F8_universe_fingerprint", """SELECT n_name, substr(sha256(string_agg(u, ',' ORDER BY u)), 1, 12) AS fp FROM (SELECT DISTINCT n_name, upper(s_name) AS u FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1""")
def _(spark, d):
    s, n = A.table(spark, d, "supplier"), A.table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name").agg(X.fingerprint(F.col("s_name")).alias("fp"))


@query("F9_exchange_listed", f"WITH {SECURITIES} SELECT DISTINCT symbol FROM securities WHERE exchange NOT IN ('OTC')")
def _(spark, d):
    return A.securities(spark, d).where(~F.col("exchange").isin("OTC") & F.col("symbol").isNotNull()).select("symbol").distinct()


_MNY = "CASE WHEN m < 0.9 THEN 'deep-OTM' WHEN m < 0.975 THEN 'OTM' WHEN m <= 1.025 THEN 'ATM' WHEN m <= 1.1 THEN 'ITM' ELSE 'deep-ITM' END"
_DTE = "CASE WHEN dte <= 14 THEN '0-14d' WHEN dte <= 45 THEN '15-45d' WHEN dte <= 90 THEN '46-90d' ELSE '90d+' END"


def _binned(spark, d):
    m, dte = F.col("spot") / (F.col("strike5") * 5), F.datediff("expiration", "snapshot_date")
    return A.contracts(spark, d).where("strike5 > 0").withColumns({"moneyness": X.label_by_floor(m, [(1.1, False, "deep-ITM"), (1.025, False, "ITM"), (0.975, True, "ATM"), (0.9, True, "OTM")], "deep-OTM"),
                                                                  "dte_bucket": X.label_by_floor(dte, [(90, False, "90d+"), (45, False, "46-90d"), (14, False, "15-45d")], "0-14d")})


@query("F10_bins", f"WITH {CONTRACTS}, b AS (SELECT spot / (strike5 * 5) AS m, expiration - snapshot_date AS dte FROM contracts WHERE strike5 > 0) SELECT {_MNY} AS moneyness, {_DTE} AS dte_bucket, count(*) AS n FROM b GROUP BY 1, 2")
def _(spark, d):
    return _binned(spark, d).groupBy("moneyness", "dte_bucket").agg(F.count("*").alias("n"))


def _topic_sql(col):
    # RE2 word boundaries know ASCII only: letters of other alphabets become an ASCII letter first
    col = f"regexp_replace({col}, '[À-ÖØ-öø-ɏ\\p{{Greek}}\\p{{Cyrillic}}\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Arabic}}\\p{{Hebrew}}\\p{{Hangul}}]', 'x', 'g')"
    parts = ", ".join(f"CASE WHEN regexp_matches({col}, '(?i){p}') THEN '{t}' END" for t, p in TX.TOPIC_PATTERNS.items())
    return f"array_to_string(list_filter([{parts}], lambda t: t IS NOT NULL), ',')"


@query("F11_topic_tags", f"SELECT conv_id, turn, {_topic_sql('text')} AS topics FROM conversations")
def _(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(TX.topic_tags(F.col("text")), ",").alias("topics"))


# --- aggregations ----------------------------------------------------------------------------

@query("A1_failed_deliveries", """SELECT l_suppkey AS symbol, min(l_returnflag) AS description, sum(l_quantity) AS total_shares_failed, round(avg(l_extendedprice), 2) AS avg_price,
  count(DISTINCT CAST(l_shipdate AS DATE)) AS trading_days, max(CAST(l_shipdate AS DATE)) AS latest_settlement FROM lineitem GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20""")
def _(spark, d):
    li = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.col("l_returnflag").alias("description"), F.col("l_quantity").alias("shares_failed"),
                                              F.col("l_extendedprice").alias("price"), F.to_date("l_shipdate").alias("settlement_date"))
    return RP.failed_deliveries(li, 20)


@query("A1_iv_summary", f"WITH {CONTRACTS} SELECT symbol, put_call, {R('avg(iv)', 4)} AS avg_iv, {R('min(iv)', 4)} AS min_iv, {R('max(iv)', 4)} AS max_iv, count(strike5) AS n_contracts FROM contracts GROUP BY 1, 2")
def _(spark, d):
    return A.contracts(spark, d).groupBy("symbol", "put_call").agg(r(F.avg("iv"), 4).alias("avg_iv"), r(F.min("iv"), 4).alias("min_iv"), r(F.max("iv"), 4).alias("max_iv"), F.count("strike5").alias("n_contracts"))


@query("A2_insider_sentiment", f"""WITH {INSIDER} SELECT symbol, count(*) FILTER (side = 'buy') AS buy_txns, count(*) FILTER (side = 'sell') AS sell_txns, CAST(sum(shares) AS DOUBLE) AS net_shares,
  CASE WHEN sum(shares) > 0 THEN 'bullish' WHEN sum(shares) < 0 THEN 'bearish' ELSE 'neutral' END AS sentiment FROM insider GROUP BY 1""")
def _(spark, d):
    return RP.insider_sentiment(A.insider(spark, d))


@query("A2_sentiment_summary", f"""WITH {NEWS}, s AS (SELECT symbol, count(*) AS articles, count(*) FILTER (score >= 0.1) AS bullish, count(*) FILTER (score > -0.1 AND score < 0.1) AS neutral,
  count(*) FILTER (score <= -0.1) AS bearish, {R('avg(score)', 3)} AS avg_score FROM news GROUP BY 1) SELECT *, CASE WHEN avg_score > 0.1 THEN 'bullish' WHEN avg_score < -0.1 THEN 'bearish' ELSE 'neutral' END AS net_sentiment FROM s""")
def _(spark, d):
    label = F.when(F.col("score") >= 0.1, "bullish").when(F.col("score") <= -0.1, "bearish").otherwise("neutral")
    return RP.sentiment_summary(A.news(spark, d), label)


@query("A3_confidence_weighted_sentiment", f"WITH {NEWS} SELECT symbol, date, {R('sum(score * greatest(confidence, 0.05)) / sum(greatest(confidence, 0.05))')} AS sent_score, count(*) AS n_articles FROM news GROUP BY 1, 2")
def _(spark, d):
    return rounded(RP.daily_signals(A.news(spark, d)), ["sent_score"])


@query("A4_weighted_profile", f"""WITH h AS (SELECT l_suppkey AS fund, l_quantity AS weight_pct, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_discount * 100 END AS duration, l_tax * 100 AS ytm, CAST(l_shipdate AS DATE) AS maturity FROM lineitem)
  SELECT fund, {R('sum(duration * weight_pct) / nullif(sum(weight_pct) FILTER (duration IS NOT NULL), 0)')} AS weighted_duration, {R('sum(ytm * weight_pct) / nullif(sum(weight_pct), 0)')} AS weighted_ytm,
   DATE '1970-01-01' + CAST(floor(avg(maturity - DATE '1970-01-01')) AS INTEGER) AS avg_maturity, count(*) AS n_holdings FROM h GROUP BY 1""")
def _(spark, d):
    h = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("fund"), F.col("l_quantity").alias("weight_pct"), F.when(F.col("l_returnflag") != "R", F.col("l_discount") * 100).alias("duration"),
                                             (F.col("l_tax") * 100).alias("ytm"), F.to_date("l_shipdate").alias("maturity"))
    return rounded(RP.weighted_profile(h, "fund", "weight_pct", ["duration", "ytm"], "maturity"), ["weighted_duration", "weighted_ytm"])


@query("A5_put_call_ratio", f"""WITH {CONTRACTS}, a AS (SELECT symbol, snapshot_date AS date, CAST(sum(CASE WHEN put_call = 'CALL' THEN volume ELSE 0 END) AS BIGINT) AS call_volume,
  CAST(sum(CASE WHEN put_call = 'PUT' THEN volume ELSE 0 END) AS BIGINT) AS put_volume FROM contracts GROUP BY 1, 2) SELECT *, {R('put_volume / nullif(call_volume, 0)::DOUBLE', 3)} AS put_call_ratio FROM a""")
def _(spark, d):
    return RP.put_call_ratio(A.contracts(spark, d).withColumnRenamed("snapshot_date", "date"), ["symbol", "date"])


_KIND = "CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'signup' THEN 'grant' WHEN 'error' THEN 'sell' WHEN 'click' THEN 'exercise' ELSE 'other' END"


@query("A5_filing_sentiment", f"""WITH e AS (SELECT CAST(ts AS DATE) AS filing_date, {_KIND} AS k FROM events), a AS (SELECT filing_date, {", ".join(f"count(*) FILTER (k = '{k}') AS {k if k != 'grant' else '"grant"'}" for k in ("buy", "sell", "exercise", "grant", "other"))}, count(*) AS n_filings FROM e GROUP BY 1)
  SELECT *, {R('(buy + 1) / (sell + 1)::DOUBLE')} AS buy_sell_ratio, {R('(buy - sell) / greatest(n_filings, 1)::DOUBLE')} AS net_sentiment FROM a""")
def _(spark, d):
    kinds = {"purchase": "buy", "signup": "grant", "error": "sell", "click": "exercise", "view": "other"}
    e = A.table(spark, d, "events").select(F.to_date("ts").alias("filing_date"), A.lookup(F.col("event_type"), kinds).alias("k"))
    return rounded(RP.filing_sentiment(e, "filing_date", "k"), ["buy_sell_ratio", "net_sentiment"])


_RATES = {"click": "y2", "view": "y10", "error": "y30"}
_RATES_SQL = "rates AS (SELECT date, " + ", ".join(f"avg(value) FILTER (series_id = '{s}') AS {n}" for s, n in _RATES.items()) + " FROM macro WHERE series_id IN ('click','view','error') GROUP BY 1)"


@query("A6_rate_environment", f"WITH {MACRO}, {_RATES_SQL} SELECT date, {R('y2')} AS y2, {R('y10')} AS y10, {R('y30')} AS y30 FROM rates")
def _(spark, d):
    return rounded(RP.series_columns(A.macro(spark, d), _RATES), ["y2", "y10", "y30"])


@query("A6_curve_inversion", f"WITH {MACRO}, {_RATES_SQL} SELECT date, {R('y2')} AS y2, {R('y10')} AS y10, {R('y10 - y2', 3)} AS spread, {R('y10 - y2', 3)} < 0 AS inverted FROM rates WHERE y2 IS NOT NULL AND y10 IS NOT NULL")
def _(spark, d):
    return rounded(RP.inversion(RP.series_columns(A.macro(spark, d), _RATES), "y2", "y10"), ["y2", "y10"])


@query("A7_latest_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(spark, d):
    o = A.table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return D.keep_latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("A7_latest_snapshot", f"WITH {HOLDINGS} SELECT fund, ticker, snapshot, CAST(market_value AS DOUBLE) AS market_value FROM holdings h WHERE snapshot = (SELECT max(snapshot) FROM holdings x WHERE x.fund = h.fund)")
def _(spark, d):
    return D.latest_slice(A.holdings(spark, d), "snapshot", ["fund"]).select("fund", "ticker", "snapshot", F.col("market_value").cast("double").alias("market_value"))


_SI = f"""p AS (SELECT symbol, settlement_date, CASE WHEN month(settlement_date) % 2 = 0 THEN days_to_cover END AS days_to_cover, CASE WHEN month(settlement_date) % 3 = 0 THEN shares_short / 400 END AS short_pct_float FROM short_interest),
  l AS (SELECT symbol, arg_max(days_to_cover, settlement_date) FILTER (days_to_cover IS NOT NULL) AS days_to_cover, arg_max(short_pct_float, settlement_date) FILTER (short_pct_float IS NOT NULL) AS short_pct_float FROM p GROUP BY 1)"""


def _last_si(spark, d):
    m = F.month("settlement_date")
    p = A.short_interest(spark, d).select("symbol", "settlement_date", F.when(m % 2 == 0, F.col("days_to_cover")).alias("days_to_cover"), F.when(m % 3 == 0, F.col("shares_short") / 400).alias("short_pct_float"))
    return RP.last_non_null(p, "symbol", "settlement_date", ["days_to_cover", "short_pct_float"])


@query("A8_squeeze_candidates", f"WITH {SHORT}, {_SI} SELECT symbol, {R('days_to_cover')} AS days_to_cover, {R('short_pct_float', 4)} AS short_pct_float FROM l WHERE short_pct_float >= 0.15 AND coalesce(days_to_cover, 999) <= 10")
def _(spark, d):
    return rounded(rounded(RP.squeeze_candidates(_last_si(spark, d), 0.15, 10), ["days_to_cover"]), ["short_pct_float"], 4)


@query("A8_short_vs_failed", f"WITH {SHORT}, {_SI}, f AS (SELECT l_partkey AS symbol, sum(l_quantity) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT l.symbol, {R('short_pct_float', 4)} AS short_pct_float, total AS total_shares_failed FROM l LEFT JOIN f USING (symbol)")
def _(spark, d):
    f = A.table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("symbol")).agg(F.sum("l_quantity").alias("total_shares_failed"))
    return _last_si(spark, d).join(f, "symbol", "left").select("symbol", r("short_pct_float", 4).alias("short_pct_float"), "total_shares_failed")


@query("A9_top_by_metric", f"WITH {FACTS}, l AS (SELECT symbol, max(row(period_end, accn, value)) AS r FROM facts WHERE metric = 'revenue' AND form = '10-K' GROUP BY 1) SELECT symbol, r[1] AS period_end, r[3] AS value FROM l ORDER BY value DESC, symbol LIMIT 10")
def _(spark, d):
    return RP.top_by_metric(A.facts(spark, d), "revenue", "10-K", 10)


@query("A10_top_n_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn FROM lineitem) WHERE rn <= 4")
def _(spark, d):
    li = A.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return RP.top_per_group(li, "l_suppkey", ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey"], 4)


_PERF = f"perf AS (SELECT symbol, min(date) AS first_date, max(date) AS last_date, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close, {R('(arg_max(close, date) / arg_min(close, date) - 1) * 100', 2)} AS total_return_pct FROM bars GROUP BY 1)"


@query("A11_period_return", f"WITH {BARS}, {_PERF} SELECT * FROM perf")
def _(spark, d):
    return RP.period_return(A.bars(spark, d))


@query("A11_versus_benchmark", f"WITH {BARS}, {_PERF}, b AS (SELECT total_return_pct AS benchmark_pct FROM perf WHERE symbol = 0) SELECT symbol, total_return_pct, benchmark_pct, {R('total_return_pct - benchmark_pct', 2)} AS relative_return_pct FROM perf, b WHERE symbol <> 0")
def _(spark, d):
    return RP.versus_benchmark(RP.period_return(A.bars(spark, d)), 0).select("symbol", "total_return_pct", "benchmark_pct", "relative_return_pct")


@query("A10_rotation", f"""WITH {BARS}, x AS (SELECT symbol, date, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS lr, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars),
  a AS (SELECT symbol, {R('avg(lr)')} AS avg_log_return, count(*) AS trading_days FROM x WHERE rn <= 20 GROUP BY 1) SELECT *, {R('avg_log_return * trading_days * 100', 2)} AS cumulative_return_pct FROM a""")
def _(spark, d):
    return RP.rotation(A.bars(spark, d), 20)


@query("A12_snapshot_change", f"""WITH {SHORT}, x AS (SELECT symbol, settlement_date, shares_short, row_number() OVER (PARTITION BY symbol ORDER BY settlement_date DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM short_interest),
  a AS (SELECT symbol, max(settlement_date) FILTER (rn = 1) AS latest_date, max(settlement_date) FILTER (rn = least(3, n)) AS prior_date, max(shares_short) FILTER (rn = 1) AS latest, max(shares_short) FILTER (rn = least(3, n)) AS prior FROM x WHERE n >= 2 GROUP BY 1)
  SELECT *, latest - prior AS change, {R('(latest - prior) / prior * 100', 2)} AS pct_change FROM a WHERE prior <> 0""")
def _(spark, d):
    return RP.snapshot_change(A.short_interest(spark, d), "symbol", "settlement_date", "shares_short", 2)


@query("A13_yoy_growth", f"""WITH {FACTS}, y AS (SELECT symbol, CAST(year(period_end) AS INTEGER) AS fiscal_year, max(row(period_end, accn, value)) AS r FROM facts WHERE metric = 'revenue' AND form = '10-K' GROUP BY 1, 2),
  l AS (SELECT symbol, fiscal_year, r[3] AS value, lag(r[3]) OVER (PARTITION BY symbol ORDER BY fiscal_year) AS prior, row_number() OVER (PARTITION BY symbol ORDER BY fiscal_year DESC) AS rn FROM y)
  SELECT symbol, fiscal_year, value, prior, {R('(value - prior) / prior * 100', 1)} AS yoy_pct FROM l WHERE rn = 1 AND prior IS NOT NULL""")
def _(spark, d):
    return RP.yoy_growth(A.facts(spark, d), "revenue", "10-K")


@query("A14_level_trend", f"""WITH {MACRO}, m AS (SELECT series_id, max(date) AS latest FROM macro GROUP BY 1),
  a AS (SELECT series_id, max(latest) AS date, arg_max(value, date) AS v, arg_max(value, date) FILTER (date <= latest - 7) AS w, arg_max(value, date) FILTER (date <= latest - 30) AS mo FROM macro JOIN m USING (series_id) GROUP BY 1)
  SELECT series_id, date, {R('v')} AS index_level, {R('(v / w - 1) * 100', 2)} AS wow_pct_change, {R('(v / mo - 1) * 100', 2)} AS mom_pct_change FROM a""")
def _(spark, d):
    return rounded(RP.level_trend(A.macro(spark, d), "series_id"), ["index_level"])


@query("A15_mention_counts", """WITH p AS (SELECT CAST(ts AS DATE) AS date, event_type AS topic, 'T' || user_id || ', T' || (user_id // 10) || ',' AS tickers, event_id AS score FROM events), x AS (SELECT date, topic, trim(unnest(string_split(tickers, ','))) AS ticker, score FROM p)
  SELECT date, topic, ticker, count(*) AS mention_count, CAST(sum(score) AS BIGINT) AS total_score FROM x WHERE ticker <> '' GROUP BY 1, 2, 3""")
def _(spark, d):
    tick = F.concat(F.lit("T"), F.col("user_id"), F.lit(", T"), F.floor(F.col("user_id") / 10), F.lit(","))
    p = A.table(spark, d, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("topic"), tick.alias("tickers"), F.col("event_id").alias("post_score"))
    return RP.mention_counts(p, "tickers")


_MEMBERS = """members AS (SELECT l_partkey AS ticker, CASE l_linenumber WHEN 1 THEN 'SPX' WHEN 2 THEN 'NDX' WHEN 3 THEN 'RUT3000' WHEN 4 THEN 'W5000' ELSE 'RUT2000' END AS index_code, 'Co ' || l_linenumber || '-' || l_partkey AS company_name,
  'S' || l_partkey % 11 AS gics_sector, CAST(date_trunc('year', l_shipdate) AS DATE) AS snapshot_date FROM lineitem)"""


def _members(spark, d):
    codes = {1: "SPX", 2: "NDX", 3: "RUT3000", 4: "W5000", 5: "RUT2000"}
    li = A.table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("ticker"), A.lookup(F.least(F.col("l_linenumber"), F.lit(5)), codes).alias("index_code"), F.concat(F.lit("Co "), F.col("l_linenumber"), F.lit("-"), F.col("l_partkey")).alias("company_name"),
                     F.concat(F.lit("S"), F.col("l_partkey") % 11).alias("gics_sector"), F.to_date(F.date_trunc("year", "l_shipdate")).alias("snapshot_date"))


@query("A16_index_flags", f"""WITH {_MEMBERS} SELECT ticker, coalesce({", ".join(f"max(company_name) FILTER (index_code = '{c}')" for c in RP.INDEX_CODES)}) AS company_name, max(gics_sector) FILTER (index_code = 'SPX') AS gics_sector,
  {", ".join(f"bool_or(index_code = '{c}') AS {f}" for c, f in RP.INDEX_FLAGS.items())} FROM members WHERE snapshot_date = (SELECT max(snapshot_date) FROM members) GROUP BY 1""")
def _(spark, d):
    return RP.index_flags(_members(spark, d))


@query("A17_index_overlap", f"WITH {_MEMBERS}, m AS (SELECT DISTINCT ticker, index_code FROM members) SELECT x.index_code AS a, y.index_code AS b, count(*) AS n FROM m x JOIN m y USING (ticker) WHERE list_position(['SPX','NDX','RUT3000','W5000','RUT2000'], x.index_code) <= list_position(['SPX','NDX','RUT3000','W5000','RUT2000'], y.index_code) GROUP BY 1, 2")
def _(spark, d):
    return RP.overlap_matrix(_members(spark, d), RP.INDEX_CODES)


@query("A17_index_lists", f"WITH {_MEMBERS} SELECT ticker, string_agg(DISTINCT index_code, ',' ORDER BY index_code) AS indices FROM members GROUP BY 1")
def _(spark, d):
    return _members(spark, d).groupBy("ticker").agg(F.array_join(F.array_sort(F.collect_set("index_code")), ",").alias("indices"))


def _pc(v):
    return f"CASE WHEN sum({v}) FILTER (put_call = 'CALL') > 0 THEN round(coalesce(sum({v}) FILTER (put_call = 'PUT'), 0) / sum({v}) FILTER (put_call = 'CALL')::DOUBLE, 4) ELSE 0 END"


@query("A18_chain_metrics", f"""WITH {CONTRACTS} SELECT symbol, count(*) AS contracts, count(*) FILTER (put_call = 'CALL') AS calls, count(*) FILTER (put_call = 'PUT') AS puts, sum(open_interest) AS total_open_interest, CAST(sum(volume) AS BIGINT) AS total_volume,
  {_pc('open_interest')} AS put_call_ratio_oi, {_pc('volume')} AS put_call_ratio_vol, {R("avg(delta) FILTER (put_call = 'CALL')", 4)} AS avg_call_delta FROM contracts GROUP BY 1""")
def _(spark, d):
    return RP.chain_metrics(A.contracts(spark, d), ["symbol"])


@query("A19_entity_master", f"""WITH {FACTS} SELECT symbol, string_agg(DISTINCT form, ',' ORDER BY form) AS forms, count(*) AS n_facts, count(DISTINCT metric) AS n_metrics, string_agg(DISTINCT metric, ',' ORDER BY metric) AS metrics, min(filed) AS first_filed, max(filed) AS last_filed, max(period_end) AS last_period_end FROM facts GROUP BY 1""")
def _(spark, d):
    return RP.entity_master(A.facts(spark, d))


_F20 = """f20 AS (SELECT symbol, CAST(year(period_end) AS INTEGER) AS period, accn // 40 AS accn, metric, CASE form WHEN '10-K' THEN 'USD' WHEN '10-Q' THEN 'USD/shares' ELSE 'pure' END AS unit, filed, value FROM facts)"""


def _facts20(spark, d):
    return A.facts(spark, d).select("symbol", F.year("period_end").alias("period"), F.floor(F.col("accn") / 40).alias("accn"), "metric",
                                    F.when(F.col("form") == "10-K", "USD").when(F.col("form") == "10-Q", "USD/shares").otherwise("pure").alias("unit"), "filed", "value")


@query("A20_wide_latest_filing", f"""WITH {FACTS}, {_F20}, a AS (SELECT symbol, period, accn, max(filed) AS mf FROM f20 GROUP BY 1, 2, 3), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, period ORDER BY mf DESC, accn DESC) AS rn FROM a) WHERE rn = 1),
  c AS (SELECT f.*, row_number() OVER (PARTITION BY f.symbol, f.period, f.metric ORDER BY CASE unit WHEN 'USD' THEN 0 WHEN 'USD/shares' THEN 1 WHEN 'shares' THEN 2 ELSE 9 END, unit, value) AS rk FROM f20 f JOIN k ON f.symbol = k.symbol AND f.period = k.period AND f.accn = k.accn)
  SELECT symbol, period, any_value(accn) AS accn, max(filed) AS filed, max(value) FILTER (metric = 'eps' AND rk = 1) AS eps, max(value) FILTER (metric = 'revenue' AND rk = 1) AS revenue, max(unit) FILTER (metric = 'eps' AND rk = 1) AS eps_unit, max(unit) FILTER (metric = 'revenue' AND rk = 1) AS revenue_unit FROM c GROUP BY 1, 2""")
def _(spark, d):
    return RP.wide_latest_filing(_facts20(spark, d), ["eps", "revenue"])


@query("A21_facts_union", """SELECT 'annual' AS period, o_custkey AS symbol, CAST(o_orderdate AS DATE) AS filed, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'quarterly', o_custkey, CAST(o_orderdate AS DATE), NULL FROM orders WHERE o_orderstatus <> 'F'""")
def _(spark, d):
    o = A.table(spark, d, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    a = o.where("o_orderstatus = 'F'").select(F.lit("annual").alias("period"), F.col("o_custkey").alias("symbol"), iso.alias("filed"), F.col("o_totalprice").cast("string").alias("value"))
    q = o.where("o_orderstatus <> 'F'").select(F.lit("quarterly").alias("period"), F.col("o_custkey").alias("symbol"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("filed"))
    return union_all([a, q]).select("period", "symbol", F.to_date(F.substring("filed", 1, 10)).alias("filed"), X.to_number("value").alias("value"))


_DIV = """dv AS (SELECT p_partkey AS symbol, CASE p_size % 7 WHEN 0 THEN 'Dividend_Aristocrat' WHEN 1 THEN 'Covered_Call_ETF' WHEN 2 THEN 'Dividend_ETF' WHEN 3 THEN 'REIT' WHEN 4 THEN 'BDC' WHEN 5 THEN 'MLP' ELSE 'Other' END AS category,
  p_size % 15 + 0.25::DOUBLE AS yield_ttm, coalesce(CASE WHEN p_partkey % 23 <> 0 THEN p_partkey % 17 - 3.0::DOUBLE END, 0) AS growth, coalesce(nullif(CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 13 * 10.0::DOUBLE END, 0), p_partkey % 11 * 10.0::DOUBLE) AS payout,
   coalesce(nullif(CASE WHEN p_partkey % 29 <> 0 THEN p_partkey % 19 / 10.0::DOUBLE END, 0), 1) AS beta, p_size - 10.0::DOUBLE AS roe, p_partkey % 31 - 5.0::DOUBLE AS margin, coalesce(CASE WHEN p_partkey % 37 <> 0 THEN p_partkey % 5 * 1.0::DOUBLE END, 0) AS dps FROM part),
  sc AS (SELECT symbol, category, yield_ttm, round(CASE WHEN yield_ttm >= 3 THEN least(yield_ttm * 3, 25) ELSE 0 END + CASE WHEN yield_ttm > 12 THEN -10 WHEN yield_ttm > 9 THEN -5 ELSE 0 END
   + CASE WHEN growth >= 10 THEN 20 WHEN growth >= 5 THEN 12 WHEN growth >= 2 THEN 6 WHEN growth < 0 THEN -15 ELSE 0 END
   + CASE WHEN category IN ('Covered_Call_ETF','Dividend_ETF') THEN 0 WHEN payout > 0 AND payout <= 60 THEN 15 WHEN payout > 60 AND payout <= 80 THEN 8 WHEN payout > 100 THEN -10 ELSE 0 END
   + CASE WHEN beta > 0 AND beta <= 0.7 THEN 10 WHEN beta <= 1 THEN 5 WHEN beta > 1.5 THEN -5 ELSE 0 END + CASE WHEN roe >= 15 THEN 8 WHEN roe >= 8 THEN 4 ELSE 0 END
   + CASE WHEN margin >= 20 THEN 5 WHEN margin < 0 THEN -8 ELSE 0 END + CASE category WHEN 'Dividend_Aristocrat' THEN 8 WHEN 'Covered_Call_ETF' THEN 5 WHEN 'Dividend_ETF' THEN 5 WHEN 'REIT' THEN 3 WHEN 'BDC' THEN 2 WHEN 'MLP' THEN 2 ELSE 0 END
   + CASE WHEN dps <= 0 THEN -20 ELSE 0 END, 1) AS score FROM dv)"""


@query("A23_dividend_score", f"WITH {_DIV} SELECT symbol, category, score FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY score DESC, symbol DESC) AS rn FROM sc WHERE yield_ttm > 0) WHERE rn <= 3")
def _(spark, d):
    p, k = A.table(spark, d, "part"), F.col("p_partkey")
    some = lambda n, x: F.when(k % n != 0, x)  # some rows lack the metric
    cats = {0: "Dividend_Aristocrat", 1: "Covered_Call_ETF", 2: "Dividend_ETF", 3: "REIT", 4: "BDC", 5: "MLP"}
    m = p.select(k.alias("symbol"), A.lookup(F.col("p_size") % 7, cats, "Other").alias("category"), (F.col("p_size") % 15 + 0.25).alias("yield_ttm"), some(23, k % 17 - 3.0).alias("growth"), some(7, k % 13 * 10.0).alias("payout"), (k % 11 * 10.0).alias("payout_annual"),
                 some(29, k % 19 / 10.0).alias("beta"), (F.col("p_size") - 10.0).alias("roe"), (k % 31 - 5.0).alias("margin"), some(37, k % 5 * 1.0).alias("dps"))
    return RP.top_per_group(RP.dividend_score(m).where("yield_ttm > 0"), "category", ["score", "symbol"], 3).select("symbol", "category", "score")


_ZONE = """CASE WHEN lat BETWEEN 10 AND 20 AND lon BETWEEN -45 AND -10 THEN 'gulf' WHEN lat BETWEEN 15 AND 30 AND lon BETWEEN -20 AND 20 THEN 'strait' WHEN lat BETWEEN 25 AND 50 AND lon BETWEEN 0 AND 45 THEN 'canal' ELSE 'unknown' END"""
ZONE_SUM = f"""count(DISTINCT mmsi) AS vessel_count, count(*) AS position_reports, {R('avg(speed)', 2)} AS avg_speed,
  {R("100.0::DOUBLE * count(*) FILTER (nav_status IN ('At anchor','Moored')) / count(nav_status)", 1)} AS pct_anchored, {R("100.0::DOUBLE * count(*) FILTER (nav_status = 'Under way') / count(nav_status)", 1)} AS pct_underway"""


@query("A24_zone_summary", f"WITH {POSITIONS}, z AS (SELECT *, {_ZONE} AS zone FROM positions) SELECT zone, {ZONE_SUM} FROM z GROUP BY 1")
def _(spark, d):
    from tidemark.operators.joins import zone_of
    return RP.zone_summary(A.positions(spark, d).withColumn("zone", zone_of(F.col("lat"), F.col("lon"))), ["zone"])


@query("A26_error_metrics", f"""WITH {CONTRACTS}, b AS (SELECT spot / (strike5 * 5) AS m, expiration - snapshot_date AS dte, spot - strike5 * 5 AS e FROM contracts WHERE strike5 > 0) SELECT {_MNY} AS moneyness, {_DTE} AS dte_bucket, count(*) AS n, {R('avg(abs(e))', 4)} AS mae, {R('avg(e)', 4)} AS bias FROM b GROUP BY 1, 2""")
def _(spark, d):
    return RP.error_metrics(_binned(spark, d), ["moneyness", "dte_bucket"], F.col("spot") - F.col("strike5") * 5)
