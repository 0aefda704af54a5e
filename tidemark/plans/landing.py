"""Landing queries.  Payloads are derived row by row from the warehouse tables, then parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import landing as L
from tidemark.plans.base import query, r
from tidemark.plans.sqlbits import BARS, FACTS, HOLDINGS, R
from tidemark.sources import adapters as A

# fixed values: names of the demo series
SERIES = {"click": ("Click rate", "count", "daily"), "view": ("View rate", "count", "daily"), "error": ("Errors", "pct", "daily")}


@query("N1_observation_list", """SELECT event_type AS series_id, CAST(ts AS DATE) AS date, value, CASE event_type WHEN 'click' THEN 'Click rate' WHEN 'view' THEN 'View rate' WHEN 'error' THEN 'Errors' END AS name,
  CASE event_type WHEN 'click' THEN 'count' WHEN 'view' THEN 'count' WHEN 'error' THEN 'pct' END AS unit, CASE WHEN event_type IN ('click','view','error') THEN 'daily' END AS frequency FROM events""")
def _(spark, d):
    e = A.table(spark, d, "events")
    obs = F.array(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("value").cast("string").alias("value")), F.struct(F.lit("2024-01-01").alias("date"), F.lit(".").alias("value")))
    return L.observations(e.select(F.to_json(F.struct(F.col("event_type").alias("series_id"), obs.alias("observations"))).alias("payload")), "payload", SERIES)


@query("N2_period_strings", """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN date_trunc('quarter', o_orderdate)::DATE WHEN 1 THEN date_trunc('quarter', o_orderdate)::DATE WHEN 2 THEN date_trunc('month', o_orderdate)::DATE
  WHEN 3 THEN date_trunc('year', o_orderdate)::DATE WHEN 4 THEN date_trunc('month', o_orderdate)::DATE WHEN 5 THEN date_trunc('month', o_orderdate)::DATE WHEN 6 THEN date_trunc('quarter', o_orderdate)::DATE END::VARCHAR AS date FROM orders""")
def _(spark, d):
    y, k = F.date_format("o_orderdate", "yyyy"), F.col("o_orderkey") % 8
    mm, q = F.date_format("o_orderdate", "MM"), F.quarter("o_orderdate").cast("string")
    s = (F.when(k == 0, F.concat(y, F.lit("Q"), q)).when(k == 1, F.concat(y, F.lit("-Q"), q)).when(k == 2, F.concat(y, mm)).when(k == 3, y).when(k == 4, F.concat(y, F.lit("-"), mm))
         .when(k == 5, F.concat(y, F.lit("M"), mm)).when(k == 6, F.concat(y, F.lit("-Q0"), q)).otherwise(F.concat(y, F.lit("M13"))))
    return A.table(spark, d, "orders").select("o_orderkey", X.period_to_date(s).cast("string").alias("date"))


@query("N3_wide_to_long", "SELECT p_partkey, k AS month, v AS value FROM (SELECT p_partkey, '2024-01' AS k, p_retailprice AS v FROM part UNION ALL SELECT p_partkey, '2024-02', p_retailprice * 2 FROM part UNION ALL SELECT p_partkey, '2024-03', CASE WHEN p_size > 20 THEN p_size::DOUBLE END FROM part) WHERE v IS NOT NULL")
def _(spark, d):
    w = A.table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("2024-01"), (F.col("p_retailprice") * 2).alias("2024-02"), F.when(F.col("p_size") > 20, F.col("p_size").cast("double")).alias("2024-03"))
    return L.melt(w, ["p_partkey"], ["2024-01", "2024-02", "2024-03"], "month", "value")


@query("N4_chain_map", "SELECT l_suppkey AS symbol, 'CALL' AS contract_type, CAST(l_shipdate AS DATE) AS expiration, l_linenumber AS dte, l_quantity AS strike, l_extendedprice AS mark, l_partkey AS \"totalVolume\", l_orderkey AS \"openInterest\", l_discount AS delta FROM lineitem")
def _(spark, d):
    li = A.table(spark, d, "lineitem")
    contract = F.struct(F.col("l_extendedprice").alias("mark"), F.col("l_partkey").alias("totalVolume"), F.col("l_orderkey").alias("openInterest"), F.col("l_discount").alias("delta"))
    strikes = F.create_map(F.col("l_quantity").cast("string"), F.array(contract))
    key = F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(":"), F.col("l_linenumber"))
    return L.chain_rows(li.select(F.col("l_suppkey").alias("symbol"), F.to_json(F.create_map(key, strikes)).alias("payload")), "payload", "CALL")


@query("N5_parallel_arrays", "SELECT o_custkey, unnest([CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 1]) AS time, unnest([o_totalprice, o_totalprice / 2]) AS open FROM orders")
def _(spark, d):
    o = A.table(spark, d, "orders").select("o_custkey", F.array(F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 1)).alias("time"), F.array("o_totalprice", F.col("o_totalprice") / 2).alias("open"))
    return L.parallel_arrays(o, ["o_custkey"], ["time", "open"])


@query("N6_nested_record", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_type END AS assignee_org, p_name || '|' || p_type AS cpc_groups, 2 AS num_inventors FROM part""")
def _(spark, d):
    p = A.table(spark, d, "part")
    kids = F.array(F.struct(F.lit("4").alias("kind"), F.col("p_type").alias("org")), F.struct(F.when(F.col("p_size") % 3 == 0, "2").otherwise("5").alias("kind"), F.col("p_brand").alias("org")))
    return p.select("p_partkey", kids.alias("kids"), F.array("p_name", F.lit(None).cast("string"), "p_type").alias("cpcs")).select(
        "p_partkey", L.first_match_child(F.col("kids"), lambda a: a["kind"].startswith("2"), "org").alias("assignee_org"), F.array_join("cpcs", "|").alias("cpc_groups"), F.size("kids").alias("num_inventors"))


@query("N7_rate_maps", "SELECT CAST(o_orderdate AS DATE) AS date, c AS currency, o_totalprice * m AS rate, 'USD/' || c AS pair FROM orders, (VALUES ('EUR', 1), ('GBP', 2)) v(c, m)")
def _(spark, d):
    rates = F.create_map(F.lit("EUR"), F.col("o_totalprice"), F.lit("GBP"), F.col("o_totalprice") * 2)
    return L.rate_pairs(A.table(spark, d, "orders").select(F.to_json(F.create_map(F.date_format("o_orderdate", "yyyy-MM-dd"), rates)).alias("p")), "p", "USD")


@query("N8_positions_with_total", """WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS account, CAST(l_partkey AS VARCHAR) AS symbol, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS mv FROM lineitem GROUP BY 1, 2)
  SELECT account, symbol, CAST(mv AS DOUBLE) AS market_value FROM p UNION ALL SELECT account, '_ACCOUNT_TOTAL', CAST(sum(mv) AS DOUBLE) FROM p GROUP BY 1""")
def _(spark, d):
    p = A.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("account"), F.col("l_partkey").cast("string").alias("symbol")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("market_value"))
    return L.with_total(p, "account", "symbol", ["market_value"]).withColumn("market_value", F.col("market_value").cast("double"))


@query("N9_snake_case_columns", "SELECT p_partkey AS part_key, p_retailprice AS p_e_pct, p_size AS market_cap_usd FROM part")
def _(spark, d):
    raw = A.table(spark, d, "part").select(F.col("p_partkey").alias("Part Key"), F.col("p_retailprice").alias(" P/E % "), F.col("p_size").alias("Market-Cap (USD)"))
    return raw.toDF(*[X.snake_case(c) for c in raw.columns])


@query("N10_dirty_numbers", "SELECT c_custkey, CASE c_nationkey % 4 WHEN 3 THEN NULL ELSE c_acctbal END AS value FROM customer")
def _(spark, d):
    b, k = F.col("c_acctbal").cast("string"), F.col("c_nationkey") % 4
    s = F.when(k == 0, F.concat(F.lit("$"), b)).when(k == 1, F.concat(b, F.lit("%"))).when(k == 2, F.regexp_replace(b, r"^(-?\d)(\d{3}\.)", "$1,$2")).otherwise("(D)")
    return A.table(spark, d, "customer").select("c_custkey", X.to_number(s).alias("value"))


@query("N11_year_month_flows", "SELECT make_date(year(o_orderdate)::INT, month(o_orderdate)::INT, 1) AS date, CASE o_orderstatus WHEN 'F' THEN 'imports' ELSE 'exports' END AS flow, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, d):
    o = A.table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.when(F.col("o_orderstatus") == "F", "imports").otherwise("exports").alias("flow"))
    return o.groupBy(F.make_date("y", "m", F.lit(1)).alias("date"), "flow").agg(F.count("*").alias("n"))


# fixed values: demo concepts in candidate order
CONCEPTS = {"revenue": ["Revenues", "SalesNet"], "assets": ["Assets"]}


@query("N12_concept_facts", """WITH f AS (SELECT o_custkey AS symbol, CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'Revenues' WHEN '2' THEN 'SalesNet' WHEN '3' THEN 'Assets' ELSE 'Other' END AS concept,
   CASE WHEN substr(o_orderpriority,1,1) = '3' THEN NULL ELSE date_trunc('quarter', o_orderdate)::DATE - CAST(CASE o_orderstatus WHEN 'F' THEN 365 ELSE 60 + o_orderkey % 60 END AS INTEGER) END AS start,
   date_trunc('quarter', o_orderdate)::DATE AS "end", CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END AS form, year(o_orderdate) AS accn, o_totalprice AS value FROM orders),
  k AS (SELECT *, CASE concept WHEN 'Revenues' THEN 0 WHEN 'SalesNet' THEN 1 WHEN 'Assets' THEN 0 END AS rk, CASE WHEN concept IN ('Revenues','SalesNet') THEN 'revenue' ELSE 'assets' END AS metric FROM f WHERE concept <> 'Other' AND form <> '8-K'
   AND (start IS NULL OR (form = '10-Q' AND "end" - start BETWEEN 80 AND 100) OR (form = '10-K' AND "end" - start BETWEEN 340 AND 380)))
  SELECT symbol, metric, CAST(start AS VARCHAR) AS start, "end", form, accn, concept, value, CASE form WHEN '10-K' THEN 'annual' ELSE 'quarterly' END AS period FROM (SELECT *, row_number() OVER (PARTITION BY symbol, metric, start, "end", form, accn ORDER BY rk, value) AS rn FROM k) WHERE rn = 1""")
def _(spark, d):
    o, p = A.table(spark, d, "orders"), F.substring("o_orderpriority", 1, 1)
    end = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    back = F.when(F.col("o_orderstatus") == "F", 365).otherwise(60 + F.col("o_orderkey") % 60).cast("int")
    f = o.select(F.col("o_custkey").alias("symbol"), F.when(p == "1", "Revenues").when(p == "2", "SalesNet").when(p == "3", "Assets").otherwise("Other").alias("concept"), F.when(p != "3", F.date_sub(end, back)).alias("start"),
                 end.alias("end"), A.lookup(F.col("o_orderstatus"), A.FORM_OF_STATUS).alias("form"), F.year("o_orderdate").cast("bigint").alias("accn"), F.col("o_totalprice").alias("value"))
    return L.concept_facts(f, CONCEPTS).withColumn("start", F.col("start").cast("string"))


@query("N13_canonical_ticker", """WITH t AS (SELECT p_size AS cik, upper(substr(p_name, 1, 2 + p_partkey % 4)) || CASE WHEN p_partkey % 5 = 0 THEN '-W' ELSE '' END AS ticker FROM part)
  SELECT cik, CASE WHEN cik = 7 THEN 'GOOD' ELSE ticker END AS ticker FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY contains(ticker, '-'), right(ticker, 1) IN ('W','R','U','M','N') AND length(ticker) > 2, length(ticker), ticker) AS rn FROM t) WHERE rn = 1""")
def _(spark, d):
    p = A.table(spark, d, "part")
    t = F.concat(F.upper(F.substring(F.col("p_name"), F.lit(1), (2 + F.col("p_partkey") % 4).cast("int"))), F.when(F.col("p_partkey") % 5 == 0, "-W").otherwise(""))
    return L.canonical_ticker(p.select(F.col("p_size").alias("cik"), t.alias("ticker")), {7: "GOOD"})


@query("N14_derived_ohlc", f"""WITH {BARS} SELECT symbol, date, {R('close / lag(close) OVER w - 1')} AS pct_change, {R('ln(close / lag(close) OVER w)')} AS log_return, {R('close - open', 4)} AS intraday_change,
  {R('high - low', 4)} AS intraday_range, {R('(high + low + close) / 3', 4)} AS vwap FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def _(spark, d):
    return L.derived_ohlc(A.bars(spark, d)).drop("open", "high", "low", "close", "volume")


_LINES = """l AS (SELECT o_custkey AS file, o_orderkey AS line_no, CASE WHEN o_orderkey % 5 = 0 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE 'M' || month(o_orderdate) || ' ' || o_totalprice END AS text, o_orderkey % 5 = 0 AS is_year FROM orders)"""


@query("N15_fill_down_sections", f"""WITH {_LINES}, f AS (SELECT *, last_value(CASE WHEN is_year THEN text END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS yr FROM l)
  SELECT file, line_no, CAST(yr AS INTEGER) AS year_ctx, CAST(substr(split_part(text, ' ', 1), 2) AS INTEGER) AS month_no, CAST(split_part(text, ' ', 2) AS DOUBLE) AS value FROM f WHERE NOT is_year AND yr IS NOT NULL""")
def _(spark, d):
    o = A.table(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy")).otherwise(F.concat(F.lit("M"), F.month("o_orderdate"), F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    lines = o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line_no"), text.alias("text"))
    f = L.fill_down(lines, "file", "line_no", F.when(F.col("text").rlike(r"^\d{4}$"), F.col("text")), "yr", block=500)
    return f.where(F.col("text").startswith("M") & F.col("yr").isNotNull()).select("file", "line_no", F.col("yr").cast("int").alias("year_ctx"), F.substring(F.split("text", " ")[0], 2, 2).cast("int").alias("month_no"), F.split("text", " ")[1].cast("double").alias("value"))


_DESC = "CASE event_type WHEN 'purchase' THEN 'Open market PURCHASE' WHEN 'error' THEN 'Shares sold to cover option' WHEN 'click' THEN 'Exercise of option' WHEN 'signup' THEN 'RSU award' ELSE '' END"


@query("N16_filing_classes", """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'other' ELSE CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'error' THEN 'sell' WHEN 'click' THEN 'exercise' WHEN 'signup' THEN 'grant' ELSE 'other' END END AS kind FROM events""")
def _(spark, d):
    desc = A.lookup(F.col("event_type"), {"purchase": "Open market PURCHASE", "error": "Shares sold to cover option", "click": "Exercise of option", "signup": "RSU award"}, "")
    return A.table(spark, d, "events").select("event_id", L.classify_filing(desc, F.when(F.col("event_id") % 9 == 0, "4/A").otherwise("4")).alias("kind"))


@query("N17_watchlist_mentions", """SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(regexp_replace(coalesce(text, ''), '[A-Z]{6,}', ' ', 'g'), '[A-Z]{2,5}'), lambda t: t IN ('THE','AND','AI','SEC','ID','US')))), ',') AS tickers FROM conversations""")
def _(spark, d):
    return A.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(L.watchlist_mentions(F.col("text"), ["THE", "AND", "AI", "SEC", "ID", "US"]), ",").alias("tickers"))


@query("N18_net_positions", "SELECT l_orderkey AS id, l_linenumber AS line, l_quantity AS noncomm_long, l_discount AS noncomm_short, l_quantity - l_discount AS net_noncomm FROM lineitem")
def _(spark, d):
    return L.net_positions(A.table(spark, d, "lineitem"), {"l_orderkey": "id", "l_linenumber": "line", "l_quantity": "noncomm_long", "l_discount": "noncomm_short", "absent": "comm_long"})


@query("N19_rating_labels", """WITH s AS (SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN round(c_acctbal / 5000 - 1, 1) END AS x FROM customer) SELECT c_custkey, CASE WHEN x IS NULL THEN 'unknown' WHEN x >= .5 THEN 'strong_buy' WHEN x >= .1 THEN 'buy' WHEN x > -.1 THEN 'neutral' WHEN x > -.5 THEN 'sell' ELSE 'strong_sell' END AS label FROM s""")
def _(spark, d):
    # scaled before it is rounded: 2750 / 5000 - 1 lies a hair above -0.45, ten times it is -4.5
    x = F.when(F.col("c_nationkey") != 3, F.round((F.col("c_acctbal") / 5000 - 1) * 10) / 10)
    return A.table(spark, d, "customer").select("c_custkey", X.vendor_rating_label(x).alias("label"))


@query("N20_vessel_codes", """WITH p AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS t, event_id % 17 AS s FROM events) SELECT event_id, CASE WHEN t IS NULL THEN 'unknown' WHEN t BETWEEN 70 AND 79 THEN 'cargo' WHEN t BETWEEN 80 AND 89 THEN 'tanker' WHEN t BETWEEN 60 AND 69 THEN 'passenger' WHEN t = 30 THEN 'fishing' ELSE 'other' END AS kind,
  CASE s """ + " ".join(f"WHEN {k} THEN '{v}'" for k, v in L.NAV_STATUS.items()) + " END AS status FROM p")
def _(spark, d):
    t = F.when(F.col("event_type") != "view", F.get_json_object("props", "$.k").cast("int"))
    return A.table(spark, d, "events").select("event_id", L.vessel_type(t).alias("kind"), L.nav_status((F.col("event_id") % 17).cast("int")).alias("status"))


@query("N21_record_feed", """SELECT c_custkey AS id, c_acctbal AS value, make_date(2000 + c_nationkey, 1, 1) AS date, c_mktsegment AS segment, CASE c_mktsegment WHEN 'BUILDING' THEN 'Bldg' WHEN 'MACHINERY' THEN 'Mach' END AS label FROM customer WHERE c_nationkey % 6 <> 0""")
def _(spark, d):
    feed = A.table(spark, d, "customer").select(F.col("c_custkey").alias("respondent"), F.when(F.col("c_nationkey") % 6 == 0, "--").otherwise(F.concat(F.lit("$"), F.col("c_acctbal"))).alias("val"),
                                               (2000 + F.col("c_nationkey")).cast("string").alias("per"), F.col("c_mktsegment").alias("seg"))
    return L.record_feed(feed, {"respondent": "id", "val": "value", "per": "period", "seg": "segment", "gone": "x"}, ["value"], "period", ("segment", {"BUILDING": "Bldg", "MACHINERY": "Mach"}, "label"), "value").drop("period")


@query("N22_two_bucket_reports", "SELECT o_custkey, 'annual' AS bucket, o_totalprice AS eps, CAST(o_orderdate AS DATE) AS \"end\" FROM orders UNION ALL SELECT o_custkey, 'quarterly', o_totalprice / 4, CAST(o_orderdate AS DATE) - 30 FROM orders UNION ALL SELECT o_custkey, 'quarterly', o_totalprice / 2, CAST(o_orderdate AS DATE) - 60 FROM orders")
def _(spark, d):
    day, rec = F.to_date("o_orderdate"), lambda v, e: F.struct(v.alias("eps"), e.alias("end"))
    o = A.table(spark, d, "orders").select("o_custkey", F.array(rec(F.col("o_totalprice"), day)).alias("annualReports"), F.array(rec(F.col("o_totalprice") / 4, F.date_sub(day, 30)), rec(F.col("o_totalprice") / 2, F.date_sub(day, 60))).alias("quarterlyReports"))
    return L.two_buckets(o, ["o_custkey"], {"annualReports": "annual", "quarterlyReports": "quarterly"}, "bucket")


@query("N23_dated_measures", "SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, m AS indicator, CASE m WHEN 'RSI' THEN CAST(l_quantity AS VARCHAR) ELSE 'n/a' END AS raw, CASE m WHEN 'RSI' THEN l_quantity END AS value FROM lineitem, (VALUES ('RSI'), ('MACD')) v(m)")
def _(spark, d):
    m = F.create_map(F.lit("RSI"), F.col("l_quantity").cast("string"), F.lit("MACD"), F.lit("n/a"))
    return L.dated_measures(A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.to_json(F.create_map(F.date_format("l_shipdate", "yyyy-MM-dd"), m)).alias("p")), "p")


@query("N24_epoch_bars", "SELECT user_id, CAST(ts AS DATE) AS date, arg_max(value, row(ts, event_id)) AS price FROM events GROUP BY 1, 2")
def _(spark, d):
    from tidemark.operators.dedup import keep_latest
    ms = F.unix_micros(F.col("ts").cast("timestamp"))
    e = A.table(spark, d, "events").select("user_id", F.floor(ms / 1000).cast("bigint").alias("ms"), ms.alias("us"), "event_id", F.col("value").alias("price"))
    bars = keep_latest(e.withColumn("date", L.epoch_day("ms", "ms")), ["user_id", "date"], ["us", "event_id"])
    return bars.select("user_id", "date", "price")


@query("N25_array_rank", "SELECT o_orderkey, i AS rank, CASE i WHEN 1 THEN o_orderstatus WHEN 2 THEN o_orderpriority ELSE 'tail' END AS symbol FROM orders, (VALUES (1), (2), (3)) v(i)")
def _(spark, d):
    s = lambda c: F.struct(c.alias("symbol"))
    o = A.table(spark, d, "orders").select("o_orderkey", F.array(s(F.col("o_orderstatus")), s(F.col("o_orderpriority")), s(F.lit("tail"))).alias("a"))
    return L.ranked_array(o, ["o_orderkey"], "a", "rank")


@query("N26_transaction_legs", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN NULL ELSE 'S' || l_partkey END AS leg_symbol, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_quantity END AS quantity, CASE WHEN l_returnflag = 'A' THEN NULL ELSE l_extendedprice END AS price,
  nullif(round(l_tax + l_discount, 4), 0) AS fees FROM lineitem""")
def _(spark, d):
    null = lambda t: F.lit(None).cast(t)
    leg = lambda at, sym, amt, px, ft, cost: F.struct(at.alias("asset_type"), sym.alias("symbol"), amt.alias("amount"), px.alias("price"), ft.alias("fee_type"), cost.alias("cost"))
    kind = F.when(F.col("l_returnflag") == "A", "CURRENCY").otherwise("EQUITY")
    legs = F.array(leg(kind, F.concat(F.lit("S"), F.col("l_partkey")), F.col("l_quantity"), F.col("l_extendedprice"), null("string"), null("double")),
                   leg(F.lit("CURRENCY"), null("string"), null("double"), null("double"), F.lit("COMMISSION"), -F.col("l_tax")), leg(F.lit("CURRENCY"), null("string"), null("double"), null("double"), F.lit("SEC"), F.col("l_discount")))
    return L.transaction_legs(A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", legs.alias("legs")), "legs").drop("legs")


@query("N27_flatten_quote", "SELECT p_partkey, p_retailprice AS last_price, p_size AS volume, CASE WHEN p_size > 25 THEN p_brand END AS exchange FROM part")
def _(spark, d):
    ref = F.when(F.col("p_size") > 25, F.struct(F.struct(F.col("p_brand").alias("name")).alias("exchange")))
    doc = F.to_json(F.struct(F.struct(F.col("p_retailprice").alias("lastPrice"), F.col("p_size").alias("totalVolume")).alias("quote"), ref.alias("reference")))
    return L.flatten(A.table(spark, d, "part").select("p_partkey", doc.alias("p")), "p", "quote struct<lastPrice:double,totalVolume:int>, reference struct<exchange:struct<name:string>>",
                     {"last_price": "quote.lastPrice", "volume": "quote.totalVolume", "exchange": "reference.exchange.name"})


@query("N28_stamped_rows", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'P' || o_custkey ELSE 'REQ' || o_custkey END AS symbol, o_totalprice AS eps_actual FROM orders")
def _(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("REQ"), F.col("o_custkey")).alias("req"), F.array(F.struct(F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("P"), F.col("o_custkey"))).alias("symbol"), F.col("o_totalprice").alias("epsActual"))).alias("a"))
    return L.stamp_symbol(o.select("o_orderkey", "req", F.inline("a")), "req", {"epsActual": "eps_actual"})


@query("N29_metric_dictionary", "SELECT p_partkey AS metric, CASE WHEN p_type < p_brand THEN p_type || ',' || p_brand ELSE p_brand || ',' || p_type END AS concepts, 2 AS n_concepts FROM part")
def _(spark, d):
    return L.metric_dictionary(A.table(spark, d, "part").select(F.col("p_partkey").alias("metric"), F.array("p_type", "p_brand", "p_type").alias("c")), "c", "metric")


@query("N30_broad_universe", f"WITH {HOLDINGS} SELECT ticker FROM (SELECT ticker FROM holdings WHERE fund = 1 AND snapshot = 1998 ORDER BY market_value DESC, ticker LIMIT 50) UNION SELECT unnest([1, 2, 999999])")
def _(spark, d):
    return L.broad_universe(A.holdings(spark, d).where("fund = 1 and snapshot = 1998"), 50, [1, 2, 999999])


@query("N30_universe_fallback", f"WITH {HOLDINGS} SELECT DISTINCT s_suppkey AS ticker FROM supplier WHERE NOT EXISTS (SELECT 1 FROM holdings WHERE fund = -1) UNION SELECT unnest([1, 2, 999999])")
def _(spark, d):
    """A fund without holdings: the listed names stand in."""
    names = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("ticker"))
    return L.broad_universe(A.holdings(spark, d).where("fund = -1"), 50, [1, 2, 999999], names)
