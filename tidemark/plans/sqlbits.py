"""The adapters once more, as SQL, for the independent check."""

from tidemark.functions.pricing import HART_DEN, HART_NUM

TRADES = """trades AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date,
  CAST(round(ln(l_extendedprice / l_quantity) * 1000) AS BIGINT) AS cents, l_quantity AS qty, l_discount AS d, l_tax AS t,
  (l_orderkey * 8 + l_linenumber) * 32768 + CAST(round(ln(l_extendedprice / l_quantity) * 1000) AS BIGINT) AS seq FROM lineitem)"""
BARS = TRADES + """, bars AS (SELECT symbol, date, (min(seq) % 32768) / 100.0::DOUBLE AS open,
  round(max(cents / 100.0::DOUBLE * (1 + d)), 4) AS high, round(min(cents / 100.0::DOUBLE * (1 - t)), 4) AS low,
  (max(seq) % 32768) / 100.0::DOUBLE AS close, sum(qty) AS volume FROM trades GROUP BY symbol, date)"""
FACTS = """facts AS (SELECT o_custkey AS symbol,
  CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'eps' WHEN '2' THEN 'revenue' WHEN '3' THEN 'net_income'
    WHEN '4' THEN 'total_assets' ELSE 'gross_profit' END AS metric,
  CASE o_orderstatus WHEN 'F' THEN '10-K' WHEN 'O' THEN '10-Q' ELSE '8-K' END AS form, o_orderkey AS accn,
  CAST(o_orderdate AS DATE) AS filed, CAST(o_orderdate AS DATE) - CAST(20 + o_orderkey % 90 AS INTEGER) AS period_end,
  o_totalprice AS value FROM orders)"""
_SD = "DATE '1995-01-01' + CAST(floor(date_sub('minute', TIMESTAMP '2024-01-01', ts) / 20) AS INTEGER)"
NEWS = f"""news AS (SELECT event_id AS article_id, user_id AS symbol, {_SD} AS date, event_type AS topic,
  (value - 50) / (value + 50) AS score, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence FROM events)"""
INSIDER = f"""insider AS (SELECT event_id AS filing_id, user_id AS symbol, {_SD} AS date,
  CASE WHEN event_type = 'error' THEN 'sell' ELSE 'buy' END AS side,
  CAST(CASE WHEN event_type = 'error' THEN -value ELSE value END AS DECIMAL(18,2)) AS shares
  FROM events WHERE event_type IN ('purchase','signup','error'))"""
MACRO = f"""macro AS (SELECT event_type AS series_id, {_SD} AS date,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value FROM events GROUP BY 1, 2)"""
SHORT = """short_interest AS (SELECT l_suppkey AS symbol, last_day(CAST(l_shipdate AS DATE)) AS settlement_date,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS shares_short, sum(l_quantity) / count(*) AS avg_volume,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / (sum(l_quantity) / count(*)) AS days_to_cover
  FROM lineitem GROUP BY 1, 2)"""
SECURITIES = """securities AS (SELECT s_suppkey AS symbol, s_name AS company_name, n_name AS country, r_name AS sector,
  s_acctbal AS shares_out, CASE WHEN s_nationkey % 5 = 0 THEN 'OTC' ELSE 'NYSE' END AS exchange
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""
HOLDINGS = """holdings AS (SELECT l_suppkey AS fund, l_partkey AS ticker, CAST(year(l_shipdate) AS INTEGER) AS snapshot,
  sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS market_value FROM lineitem GROUP BY 1, 2, 3)"""
CONTRACTS = """contracts AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS expiration,
  CAST(l_shipdate AS DATE) - CAST(1 + l_linenumber * 13 + l_partkey % 60 AS INTEGER) AS snapshot_date,
  CAST(round(ln(l_extendedprice / l_quantity) * 10 / 5) AS BIGINT) AS strike5,
  CASE WHEN l_returnflag = 'R' THEN 'PUT' ELSE 'CALL' END AS put_call, l_quantity AS open_interest,
  CAST(l_linenumber AS BIGINT) AS volume, 0.1::DOUBLE + l_discount * 3 AS iv, l_tax AS delta,
  round(ln(l_extendedprice / l_quantity) * 10, 2) AS spot, l_orderkey AS order_id FROM lineitem)"""
POSITIONS = """positions AS (SELECT event_id, user_id AS mmsi, ts, value % 40 + 10 AS lat, value % 90 - 45 AS lon,
  value % 25 AS speed, CAST(json_extract_string(props, '$.k') AS INTEGER) AS type_code,
  CASE event_type WHEN 'click' THEN 'Under way' WHEN 'view' THEN 'At anchor' WHEN 'purchase' THEN 'Moored'
    WHEN 'signup' THEN 'Aground' ELSE 'Undefined' END AS nav_status FROM events)"""


def R(expr: str, n: int = 6) -> str:
    """Rounded, with negative zero made positive."""
    return f"(round({expr}, {n}) + 0.0::DOUBLE)"


def normal_tail(x):
    """SQL for the chance beyond |x| on one side."""
    a = f"abs({x})"
    num, den = "", ""
    for i, c in enumerate(HART_NUM):
        num = f"{c!r}::DOUBLE" if i == 0 else f"({num} * {a} + {c!r}::DOUBLE)"
    for i, c in enumerate(HART_DEN):
        den = f"{c!r}::DOUBLE" if i == 0 else f"({den} * {a} + {c!r}::DOUBLE)"
    return f"exp(-{a} * {a} / 2) * {num} / {den}"


def t_tail(src: str, t: str, df: str, keep: str) -> str:
    """SQL table (keep, p): two-sided Student tails, by Simpson's rule on the cosine form of the density (independent of the library's)."""
    hi = f"CASE WHEN {df} > 20 THEN least(pi() / 2, atan((abs({t}) + 60) / sqrt({df}))) ELSE pi() / 2 END"
    lo = f"atan(abs({t}) / sqrt({df}))"
    return f"""(SELECT {keep}, 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi()) * h / 3 * list_sum(list_transform(range(0, 4001), lambda k: (CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(lo + k * h), v - 1))) AS p
  FROM (SELECT {keep}, {df}::DOUBLE AS v, {lo} AS lo, ({hi} - {lo}) / 4000 AS h FROM {src} WHERE {t} IS NOT NULL AND NOT isnan({t}) AND {df} > 0))"""


def normal_quantile(p: str) -> str:
    """SQL for the normal quantile, by halving an interval fifty times."""
    return f"list_reduce(list_transform(range(1, 51), lambda k: 8.0::DOUBLE / pow(2, k - 1)), lambda x, w: x + CASE WHEN (CASE WHEN x > 0 THEN 1 - {normal_tail('x')} ELSE {normal_tail('x')} END) < {p} THEN w / 2 ELSE -w / 2 END, 0.0::DOUBLE)"
