"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof as AS, dedup as D, joins as J
from tidemark.plans.base import query, r, rounded
from tidemark.plans.sqlbits import BARS, CONTRACTS, FACTS, HOLDINGS, INSIDER, MACRO, NEWS, POSITIONS, R, SECURITIES, SHORT
from tidemark.sources import adapters as A

_SEC = "company_name, country, sector, exchange"


@query("J1_prices_enriched", f"WITH {BARS}, {SECURITIES} SELECT b.*, {_SEC} FROM bars b LEFT JOIN securities s USING (symbol)")
def _(spark, d):
    return J.enrich(A.bars(spark, d), A.securities(spark, d), "symbol", ["company_name", "country", "sector", "exchange"])


@query("J1_securities_full", f"""WITH {SECURITIES}, ids AS (SELECT p_partkey AS ticker, 'FIGI' || p_partkey AS figi, p_brand AS cusip FROM part)
  SELECT s.*, figi, cusip FROM securities s LEFT JOIN ids ON symbol = ticker""")
def _(spark, d):
    return J.enrich(A.securities(spark, d), _ids(spark, d).withColumnRenamed("ticker", "symbol"), "symbol", ["figi", "cusip"])


def _ids(spark, d):
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("ticker"), F.concat(F.lit("FIGI"), F.col("p_partkey")).alias("figi"),
                                            F.col("p_brand").alias("cusip"))


@query("J1_fund_holdings_full", f"""WITH {HOLDINGS}, {SECURITIES}, ids AS (SELECT p_partkey AS ticker, 'FIGI' || p_partkey AS figi FROM part)
  SELECT h.fund, h.ticker, h.snapshot, CAST(h.market_value AS DOUBLE) AS market_value, f.country AS fund_country, s.country, s.sector, i.figi
  FROM holdings h LEFT JOIN securities f ON h.fund = f.symbol LEFT JOIN securities s ON h.ticker = s.symbol LEFT JOIN ids i USING (ticker)""")
def _(spark, d):
    sec = A.securities(spark, d)
    h = J.enrich(A.holdings(spark, d), sec.select(F.col("symbol").alias("fund"), F.col("country").alias("fund_country")), "fund", ["fund_country"])
    h = J.enrich(h, sec.select(F.col("symbol").alias("ticker"), "country", "sector"), "ticker", ["country", "sector"])
    return J.enrich(h, _ids(spark, d), "ticker", ["figi"]).withColumn("market_value", F.col("market_value").cast("double"))


@query("J1_index_holdings", f"""WITH {SECURITIES}, m AS (SELECT p_partkey AS symbol, p_type AS index_code, p_size AS weight FROM part)
  SELECT m.symbol, index_code, weight, sector, exchange, 'FIGI' || m.symbol AS figi FROM m LEFT JOIN securities s USING (symbol)""")
def _(spark, d):
    m = A.table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_type").alias("index_code"), F.col("p_size").alias("weight"))
    m = J.enrich(m, A.securities(spark, d), "symbol", ["sector", "exchange"])
    return J.enrich(m, _ids(spark, d).withColumnRenamed("ticker", "symbol"), "symbol", ["figi"])


@query("J1_insider_by_sector", f"""WITH {INSIDER}, {SECURITIES} SELECT filing_id, symbol, date, side, CAST(shares AS DOUBLE) AS shares, sector, company_name
  FROM insider LEFT JOIN securities USING (symbol)""")
def _(spark, d):
    return J.enrich(A.insider(spark, d), A.securities(spark, d), "symbol", ["sector", "company_name"]).withColumn("shares", F.col("shares").cast("double"))


@query("J1_institutional_by_name", """SELECT o_orderkey, c_name AS company_name, CAST(s_suppkey AS DOUBLE) AS symbol, o_totalprice AS value_usd FROM orders
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON replace(c_name, 'Customer', 'Supplier') = s_name""")
def _(spark, d):
    o, c, s = (A.table(spark, d, t) for t in ("orders", "customer", "supplier"))
    ih = o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", F.col("c_name").alias("company_name"), F.col("o_totalprice").alias("value_usd"))
    ref = s.select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("company_name"), F.col("s_suppkey").alias("symbol"))
    return J.enrich(ih, ref, "company_name", ["symbol"]).withColumn("symbol", F.col("symbol").cast("double"))


@query("J1_earnings_with_index", f"""WITH {FACTS}, {SECURITIES} SELECT f.symbol, f.filed, f.value AS eps, s.sector, coalesce(s.exchange = 'NYSE', false) AS listed
  FROM facts f LEFT JOIN securities s USING (symbol) WHERE f.metric = 'eps'""")
def _(spark, d):
    f = A.facts(spark, d).where("metric = 'eps'").select("symbol", "filed", F.col("value").alias("eps"))
    return J.enrich(f, A.securities(spark, d), "symbol", ["sector", "exchange"]).select(
        "symbol", "filed", "eps", "sector", F.coalesce(F.col("exchange") == "NYSE", F.lit(False)).alias("listed"))


@query("J2_inner_on_date", f"""WITH {BARS}, {MACRO}, c AS (SELECT date, value FROM macro WHERE series_id = 'click')
  SELECT symbol, count(*) AS n, {R('corr(close, value)')} AS corr FROM bars JOIN c USING (date) GROUP BY 1""")
def _(spark, d):
    c = A.macro(spark, d).where("series_id = 'click'").select("date", "value")
    return A.bars(spark, d).select("symbol", "date", "close").join(c, "date").groupBy("symbol").agg(
        F.count("*").alias("n"), r(F.corr("close", "value")).alias("corr"))


_SECTOR = f"""sec_w AS (SELECT fund, n_name AS sector, sum(market_value) AS mv FROM holdings h JOIN part ON ticker = p_partkey
    JOIN nation ON p_size % 25 = n_nationkey WHERE snapshot = (SELECT max(snapshot) FROM holdings x WHERE x.fund = h.fund) GROUP BY 1, 2),
  expo AS (SELECT fund, sector, round(CAST(100 * mv AS DOUBLE) / CAST(sum(mv) OVER (PARTITION BY fund) AS DOUBLE), 2) AS weight_pct FROM sec_w)"""


def _sectored(spark, d):
    """Latest holdings of every fund with a sector and a weight in percent."""
    h = D.latest_slice(A.holdings(spark, d), "snapshot", ["fund"])
    sector = A.table(spark, d, "part").join(A.table(spark, d, "nation"), F.col("p_size") % 25 == F.col("n_nationkey")).select(
        F.col("p_partkey").alias("ticker"), F.col("n_name").alias("sector"))
    return h.join(sector, "ticker")


@query("A22_sector_exposure", f"WITH {HOLDINGS}, {_SECTOR} SELECT fund, sector, weight_pct FROM expo")
def _(spark, d):
    return J.exposure(_sectored(spark, d))


@query("J3_sector_overweight", f"""WITH {HOLDINGS}, {_SECTOR}, a AS (SELECT * FROM expo WHERE fund = 1), b AS (SELECT * FROM expo WHERE fund = 2)
  SELECT coalesce(a.sector, b.sector) AS sector, coalesce(a.weight_pct, 0) AS fund_pct, coalesce(b.weight_pct, 0) AS benchmark_pct,
   {R('coalesce(a.weight_pct, 0) - coalesce(b.weight_pct, 0)', 2)} AS overweight_pct FROM a FULL JOIN b ON a.sector = b.sector""")
def _(spark, d):
    e = J.exposure(_sectored(spark, d))
    return J.overweight(e.where("fund = 1"), e.where("fund = 2"))


@query("J4_latest_per_metric", f"""WITH {FACTS}, {BARS}, l AS (SELECT symbol, metric, arg_max(value, row(period_end, accn)) AS v FROM facts GROUP BY 1, 2),
  p AS (SELECT symbol, arg_max(close, date) AS close FROM bars GROUP BY 1),
  m AS (SELECT symbol, max(v) FILTER (metric = 'eps') AS eps, max(v) FILTER (metric = 'revenue') AS revenue, max(v) FILTER (metric = 'net_income') AS net_income FROM l GROUP BY 1)
  SELECT symbol, close, eps, revenue, net_income, {R("CASE WHEN eps > 0 THEN close / eps END", 9)} AS pe,
   {R("CASE WHEN revenue > 0 THEN net_income / revenue END")} AS margin FROM p LEFT JOIN m USING (symbol)""")
def _(spark, d):
    return rounded(rounded(J.valuation(A.facts(spark, d), A.bars(spark, d)), ["pe"], 9), ["margin"])


_LATEST = """lp AS (SELECT symbol, filed, metric, arg_max(value, row(period_end, accn)) AS value FROM facts GROUP BY 1, 2, 3)"""


@query("J5_asof_fundamentals", f"""WITH {BARS}, {FACTS}, {_LATEST} SELECT b.symbol, b.date, b.close, f1.value AS eps, f2.value AS revenue FROM bars b
  ASOF LEFT JOIN (SELECT * FROM lp WHERE metric = 'eps') f1 ON b.symbol = f1.symbol AND b.date >= f1.filed
  ASOF LEFT JOIN (SELECT * FROM lp WHERE metric = 'revenue') f2 ON b.symbol = f2.symbol AND b.date >= f2.filed""")
def _(spark, d):
    wide = AS.latest_period_facts(A.facts(spark, d), ["eps", "revenue"])
    return AS.asof_columns(A.bars(spark, d).select("symbol", "date", "close"), wide, "symbol", "date", "filed", ["eps", "revenue"])


@query("J5_asof_events_strict", f"""WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
  v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2)
  SELECT e.event_id, e.user_id, CAST(v.view_id AS DOUBLE) AS view_id FROM e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts > v.ts""")
def _(spark, d):
    e = A.table(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return AS.asof_join(left, right, ["user_id"], "ts", "ts", ["view_id"], strict=True, split="day").drop("ts").withColumn("view_id", F.col("view_id").cast("double"))


@query("J6_asof_publication_lag", f"""WITH {BARS}, {SHORT}, s AS (SELECT symbol, settlement_date + 7 AS public_date, max(days_to_cover) AS dtc, max(shares_short) AS ss
   FROM short_interest GROUP BY 1, 2) SELECT b.symbol, b.date, {R('dtc')} AS si_days_to_cover, ss AS si_shares_short FROM bars b
   ASOF LEFT JOIN s ON b.symbol = s.symbol AND b.date >= s.public_date""")
def _(spark, d):
    from tidemark.operators.factors import short_public
    out = AS.asof_join(A.bars(spark, d).select("symbol", "date"), short_public(A.short_interest(spark, d)), ["symbol"], "date", "public_date",
                       ["si_days_to_cover", "si_shares_short"])
    return rounded(out, ["si_days_to_cover"])


@query("J7_asof_broadcast_macro", f"""WITH {BARS}, {MACRO} SELECT b.symbol, b.date, {R('c.value')} AS click, {R('v.value')} AS view FROM bars b
  ASOF LEFT JOIN (SELECT * FROM macro WHERE series_id = 'click') c ON b.date >= c.date ASOF LEFT JOIN (SELECT * FROM macro WHERE series_id = 'view') v ON b.date >= v.date""")
def _(spark, d):
    return rounded(AS.broadcast_by_date(A.bars(spark, d).select("symbol", "date"), A.macro(spark, d), ["click", "view"]), ["click", "view"])


@query("J8_trailing_insider_sum", f"""WITH {BARS}, {INSIDER} SELECT b.symbol, b.date, CAST(sum(i.shares) AS DOUBLE) AS net_90d FROM bars b LEFT JOIN
  (SELECT symbol, date + 3 AS pub, shares FROM insider) i ON b.symbol = i.symbol AND i.pub <= b.date AND i.pub > b.date - 90 GROUP BY 1, 2""")
def _(spark, d):
    out = AS.trailing_range_agg(A.bars(spark, d).select("symbol", "date"), A.insider(spark, d), "symbol", "date", F.date_add("date", 3),
                                {"net_90d": F.col("shares")}, 90)
    return out.withColumn("net_90d", F.col("net_90d").cast("double"))


@query("J9_trailing_news_mean", f"""WITH {BARS}, {NEWS} SELECT b.symbol, b.date, {R('avg(n.score)')} AS news_score, count(n.score) AS news_count FROM bars b LEFT JOIN
  news n ON b.symbol = n.symbol AND n.date <= b.date AND n.date > b.date - 21 GROUP BY 1, 2""")
def _(spark, d):
    out = AS.trailing_range_agg(A.bars(spark, d).select("symbol", "date"), A.news(spark, d), "symbol", "date", "date", {}, 21,
                                counts={"news_count": F.col("score")}, means={"news_score": F.col("score")})
    return rounded(out, ["news_score"])


@query("J10_forward_entry", f"""WITH {BARS}, {NEWS} SELECT n.article_id, n.symbol, n.date, CAST(b.entry_date AS VARCHAR) AS entry_date, b.entry_close FROM news n
  ASOF LEFT JOIN (SELECT symbol, date AS entry_date, close AS entry_close FROM bars) b ON n.symbol = b.symbol AND n.date < b.entry_date""")
def _(spark, d):
    right = A.bars(spark, d).select("symbol", F.col("date").alias("entry_date"), F.col("close").alias("entry_close"))
    return AS.asof_join(A.news(spark, d).select("article_id", "symbol", "date"), right, ["symbol"], "date", "entry_date",
                        ["entry_date", "entry_close"], forward=True, strict=True, repeated=True).withColumn("entry_date", F.col("entry_date").cast("string"))


@query("J10_forward_align_guarded", f"""WITH {BARS}, {NEWS}, j AS (SELECT n.article_id, n.symbol, n.date, b.d0 FROM news n
  ASOF LEFT JOIN (SELECT symbol, date AS d0 FROM bars) b ON n.symbol = b.symbol AND n.date <= b.d0) SELECT * FROM j WHERE d0 - date <= 5""")
def _(spark, d):
    right = A.bars(spark, d).select("symbol", F.col("date").alias("d0"))
    j = AS.asof_join(A.news(spark, d).select("article_id", "symbol", "date"), right, ["symbol"], "date", "d0", ["d0"], forward=True, repeated=True)
    return j.where(F.datediff("d0", "date") <= 5)


@query("J11_events_for_symbols", f"""WITH {MACRO} SELECT m.date, m.series_id, s.symbol FROM macro m, (VALUES (1),(2),(3),(5)) s(symbol) WHERE m.value > 60""")
def _(spark, d):
    return J.for_symbols(A.macro(spark, d).where("value > 60").select("date", "series_id"), [1, 2, 3, 5])


@query("J12_strike_grid", """SELECT s_suppkey AS symbol, k AS strike_pct, t AS dte, p AS put_call FROM supplier,
  (VALUES (80),(90),(100),(110),(120)) a(k), (VALUES (7),(30),(90)) b(t), (VALUES ('CALL'),('PUT')) c(p)""")
def _(spark, d):
    return J.grid(A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol")),
                  {"strike_pct": [80, 90, 100, 110, 120], "dte": [7, 30, 90], "put_call": ["CALL", "PUT"]})


@query("J13_not_yet_processed", """SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def _(spark, d):
    return D.unseen(A.table(spark, d, "orders").select("o_orderkey"), A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("J14_eligible_rows", f"""WITH {BARS}, {NEWS} SELECT article_id, symbol, date FROM news n WHERE EXISTS (SELECT 1 FROM bars b WHERE b.symbol = n.symbol AND b.date = n.date AND b.volume >= 10)""")
def _(spark, d):
    ok = A.bars(spark, d).where("volume >= 10").select("symbol", "date")
    return A.news(spark, d).select("article_id", "symbol", "date").join(ok, ["symbol", "date"], "left_semi")


@query("J15_layered_reference", """WITH e AS (SELECT p_partkey AS symbol, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS company_name FROM part),
  i AS (SELECT s_suppkey AS symbol, s_name AS company_name, CAST(s_nationkey AS VARCHAR) AS sector FROM supplier),
  f AS (SELECT c_custkey AS symbol, c_name AS company_name, c_mktsegment AS industry, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS market_cap FROM customer)
  SELECT e.symbol, coalesce(nullif(e.company_name, ''), nullif(i.company_name, ''), f.company_name) AS company_name, i.sector, f.industry, f.market_cap,
   CASE WHEN f.market_cap IS NOT NULL THEN 'profile' WHEN i.symbol IS NOT NULL THEN 'index_members' ELSE 'filings' END AS primary_source
  FROM e LEFT JOIN i USING (symbol) LEFT JOIN f USING (symbol)""")
def _(spark, d):
    base = A.table(spark, d, "part").select(F.col("p_partkey").alias("symbol"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("company_name"))
    idx = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("company_name"), F.col("s_nationkey").cast("string").alias("sector"))
    prof = A.table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_name").alias("company_name"), F.col("c_mktsegment").alias("industry"),
                                                F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("market_cap"))
    return J.layered_reference(base, [("index_members", idx, None), ("profile", prof, "market_cap")], "symbol", "filings")


@query("J16_holdings_overlap", f"""WITH {HOLDINGS}, l AS (SELECT h.*, CAST(market_value AS DOUBLE) / CAST(sum(market_value) OVER (PARTITION BY fund) AS DOUBLE) * 100 AS w FROM holdings h
   WHERE snapshot = (SELECT max(snapshot) FROM holdings x WHERE x.fund = h.fund))
  SELECT a.ticker, {R('a.w')} AS weight_a, {R('b.w')} AS weight_b FROM l a JOIN l b ON a.ticker = b.ticker WHERE a.fund = 3 AND b.fund = 7""")
def _(spark, d):
    h = D.latest_slice(A.holdings(spark, d).where("fund in (3, 7)"), "snapshot", ["fund"])
    return rounded(J.holdings_overlap(h, 3, 7), ["weight_a", "weight_b"])


@query("J17_point_in_zone", f"""WITH {POSITIONS} SELECT event_id, CASE WHEN lat BETWEEN 10 AND 20 AND lon BETWEEN -45 AND -10 THEN 'gulf'
  WHEN lat BETWEEN 15 AND 30 AND lon BETWEEN -20 AND 20 THEN 'strait' WHEN lat BETWEEN 25 AND 50 AND lon BETWEEN 0 AND 45 THEN 'canal' ELSE 'unknown' END AS zone FROM positions""")
def _(spark, d):
    return A.positions(spark, d).select("event_id", J.zone_of(F.col("lat"), F.col("lon"), J.ZONES).alias("zone"))


@query("J18_five_key_match", f"""WITH {CONTRACTS}, a AS (SELECT symbol, snapshot_date, expiration, strike5, put_call, count(*) AS n_obs, {R('avg(iv)')} AS iv FROM contracts WHERE volume <= 4 GROUP BY ALL),
  b AS (SELECT symbol, snapshot_date, expiration, strike5, put_call, count(*) AS n_model, {R('avg(spot)')} AS model FROM contracts WHERE volume > 3 GROUP BY ALL)
  SELECT * FROM a JOIN b USING (symbol, snapshot_date, expiration, strike5, put_call)""")
def _(spark, d):
    k, c = ["symbol", "snapshot_date", "expiration", "strike5", "put_call"], A.contracts(spark, d)
    a = c.where("volume <= 4").groupBy(*k).agg(F.count("*").alias("n_obs"), r(F.avg("iv")).alias("iv"))
    return a.join(c.where("volume > 3").groupBy(*k).agg(F.count("*").alias("n_model"), r(F.avg("spot")).alias("model")), k)


@query("J19_unmapped_tickers", """SELECT DISTINCT t FROM (SELECT upper(p_name) AS t FROM part UNION SELECT upper(s_name) FROM supplier UNION SELECT upper(c_name) FROM customer)
  WHERE t NOT IN (SELECT upper(replace(s_name, 'Supplier', 'Customer')) FROM supplier)""")
def _(spark, d):
    p, s, c = (A.table(spark, d, t) for t in ("part", "supplier", "customer"))
    sources = [p.select(F.col("p_name").alias("t")), s.select(F.col("s_name").alias("t")), c.select(F.col("c_name").alias("t"))]
    return J.unmapped(sources, s.select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("t")), "t")
